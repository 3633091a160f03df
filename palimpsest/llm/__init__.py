"""Operators for preparing training corpora: deduplication, filtering, formatting and mixing."""
