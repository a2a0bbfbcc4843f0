"""Training-data operators: fingerprints, classifiers, deduplication, decontamination, packing."""
