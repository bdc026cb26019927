"""DataFrame-level operators (joins, aggregations, windows, sampling, metrics)."""
