"""Scalar functions: text and vector similarity, both as plain Python and as column expressions."""
