"""Readers of document formats: bytes in, ordered blocks out, and the renderers that replay them."""
