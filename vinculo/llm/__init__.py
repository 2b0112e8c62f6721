"""Training-data operators: sharding, privacy, extraction, duplicates, tokens, leakage, toxicity."""
