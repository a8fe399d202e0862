"""Scalar functions: RDF terms as strings, gate identities, filter conditions."""
