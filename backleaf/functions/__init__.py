"""functions of the index engine."""
