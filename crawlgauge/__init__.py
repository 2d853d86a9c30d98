"""crawlgauge: website audits and answer-visibility analytics over crawl tables, on Spark DataFrames."""
