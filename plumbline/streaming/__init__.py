"""Incremental scoring of books as they arrive."""
