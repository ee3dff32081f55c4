"""Relational operators over documents, segments, terms and runs."""
