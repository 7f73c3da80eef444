"""Column functions: no actions, no UDFs but the one for international host names."""
