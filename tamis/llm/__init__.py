"""Training-data operators: mixing, toxicity, near-duplicates, decontamination, formatting, token counts, sharding."""
