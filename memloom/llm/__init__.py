"""Training-data operators: language, duplicates, shards, personal data, mixing, tokens, toxicity."""
