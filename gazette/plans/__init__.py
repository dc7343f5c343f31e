"""gazette.plans."""
