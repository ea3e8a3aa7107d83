"""DataFrame-to-DataFrame building blocks (joins, aggregations, dedup, set operations)."""
