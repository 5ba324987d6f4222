"""Training-data operators: filters, deduplication, mixing, search, packing and classifiers over document tables."""
