"""Training-data operators: decontamination, deduplication, packing, formatting, token files and filters."""
