"""Exact probabilistic queries over uncertain facts, on PySpark."""
