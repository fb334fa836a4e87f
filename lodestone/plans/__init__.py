"""The graph model and traversal plans."""
