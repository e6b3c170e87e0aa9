"""sources of the index engine."""
