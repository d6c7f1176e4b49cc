"""Training-data operators: near-duplicates, repeats, mixing, search, extraction, scoring, encoding."""
