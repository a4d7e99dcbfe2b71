"""Training-data operators: dedup, fingerprints, archives, packing, mixing, search, toxicity, chat."""
