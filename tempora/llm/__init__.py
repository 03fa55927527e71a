"""Training-data operators: scoring, deduplication, decontamination, mixing and sharding of document tables."""
