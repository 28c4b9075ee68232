"""Training-data operators: language, duplicates, packing, quality, toxicity, tokens, models, search."""
