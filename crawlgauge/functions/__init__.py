"""Column expressions (no UDFs): HTML signals, text measures, colours, scoring, JSON-LD."""
