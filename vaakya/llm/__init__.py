"""Training-data operators: deduplication, extraction, packing, scoring, fixity."""
