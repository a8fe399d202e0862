"""Relational, circuit, path and counting operators."""
