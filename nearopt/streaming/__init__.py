"""Streams of rows to be scored."""
