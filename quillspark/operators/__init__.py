"""Operators over document, chunk and corpus tables."""
