"""Training-data operators: cleaning, deduplication, mixing, formatting, packing and exact search."""
