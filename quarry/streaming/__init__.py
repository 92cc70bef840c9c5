"""Incremental runs over trees that change."""
