"""Readers: crawl metadata archives, path lists, top sites, prefix tables, worker logs."""
