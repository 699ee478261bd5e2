"""Training-data operators: deduplication, filtering, scanning and mixing of large text corpora."""
