"""Operators for preparing training data: extraction, scoring, deduplication, mixing and formatting."""
