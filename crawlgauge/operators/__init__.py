"""Analyses over crawl tables. Each takes and returns DataFrames."""
