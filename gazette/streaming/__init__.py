"""gazette.streaming."""
