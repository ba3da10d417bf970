"""Training-data operators: scoring, near duplicates, search, secrets, mixing, packing, shards."""
