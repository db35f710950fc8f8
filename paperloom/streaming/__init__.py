"""Streaming ingestion of pages."""
