"""gazette.functions."""
