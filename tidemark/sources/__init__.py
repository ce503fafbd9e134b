"""Readers, writers and the SQL entry point."""
