"""Tidemark: point-in-time analytics on PySpark, expressed as DataFrame plans."""
