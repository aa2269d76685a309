"""Training-data operators: language ID, archives, dedup, extraction, search, scoring, packing, tokenizing."""
