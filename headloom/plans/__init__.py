"""Plans that span operators: lint rules, enrichment, the report."""
