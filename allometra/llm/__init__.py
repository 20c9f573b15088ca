"""Training-data operators: text cleaning, deduplication, decontamination, mixing and packing."""
