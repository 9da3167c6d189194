"""Training-data operators: scoring, scanning, packing, encoding and deduplication."""
