"""Training-data operators: deduplication, filtering, mixing, sharding and tokenising of text corpora."""
