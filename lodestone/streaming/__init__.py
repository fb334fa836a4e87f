"""Change feeds and coordination as Structured Streaming queries and their batch forms."""
