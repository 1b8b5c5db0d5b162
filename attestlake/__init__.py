"""Evidence verification and document analytics on PySpark."""
