"""Lookups, ranking, sheets and formats as DataFrame operations."""
