"""Readers of file formats."""
