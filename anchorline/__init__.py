"""Spark jobs that turn documents and chat messages into anchored, bounded text context."""
