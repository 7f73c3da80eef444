"""Aggregates over enriched responses. Counts are exact and global; caps apply only where a table is shown."""
