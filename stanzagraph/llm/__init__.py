"""Training-data operators: packing, formatting, quality, sharding, dedup, language, counts."""
