"""Readers, writers and the tables they maintain."""
