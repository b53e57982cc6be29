"""Training-data operators: near-duplicates, scans, filters, scoring, formatting and packing of text."""
