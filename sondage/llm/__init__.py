"""Training-data operators: token counts, sharding, scoring, filtering, deduplication."""
