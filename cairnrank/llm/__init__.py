"""Training-data operators: dedup, decontamination, classification, mixing and token output."""
