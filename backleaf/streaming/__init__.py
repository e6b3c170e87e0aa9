"""streaming of the index engine."""
