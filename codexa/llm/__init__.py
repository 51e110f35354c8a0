"""Training-data operators: scoring, filtering, deduplication, tokenisation and storage of texts."""
