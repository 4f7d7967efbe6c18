"""Training-data operators: language ID, deduplication, mixing, packing, sharding, extraction and media columns."""
