"""gazette.operators."""
