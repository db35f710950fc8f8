"""Readers of pages, rules and tables, and writers of results."""
