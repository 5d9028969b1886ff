"""Document-quality analytics on PySpark."""
