"""backleaf: authenticated inverted indexes over append-only logs, on PySpark."""
