"""gazette.sources."""
