"""Readers of files and their formats."""
