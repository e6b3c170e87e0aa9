"""plans of the index engine."""
