"""Readers, writers and the views that the queries start from."""
