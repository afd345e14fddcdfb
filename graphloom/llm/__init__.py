"""Training-data operators: dedup, decontamination, quality, packing, extraction."""
