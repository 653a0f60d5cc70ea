"""Readers of documents and their parts."""
