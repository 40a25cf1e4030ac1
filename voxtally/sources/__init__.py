"""Readers, writers, table layout and constraint checks."""
