"""Training-data operators: filtering, deduplication, mixing, tokenising, packing and search."""
