"""The same aggregates over a stream of responses: their sums merge, so batches add up to the whole."""
