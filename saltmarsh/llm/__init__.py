"""Operators for preparing training corpora, and their queries."""
