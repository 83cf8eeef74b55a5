"""Training-data operators: deduplication, filtering, redaction and mixing of documents."""
