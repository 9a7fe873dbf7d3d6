"""Training-data operators: dedup, archives, packing, language models and classifiers on Spark."""
