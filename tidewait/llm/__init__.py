"""Training-data operators: deduplication, decontamination, mixing, quality, sharding, packing, language."""
