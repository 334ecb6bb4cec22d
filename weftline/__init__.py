"""Typed dataflow analytics on PySpark."""
