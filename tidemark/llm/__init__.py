"""Training-data operators: tokenising, deduplication, packing, formatting, search and classification."""
