"""Readers and writers of documents, chunks and their metadata."""
