"""logweave: pattern-level text and log analytics on PySpark."""
