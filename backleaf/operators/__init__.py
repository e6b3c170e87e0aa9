"""operators of the index engine."""
