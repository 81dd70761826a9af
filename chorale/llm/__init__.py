"""Training-data operators: dedup, scans, tokenisation, scoring, search."""
