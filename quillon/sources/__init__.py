"""Readers: file trees, documents, code, commit logs, fixtures."""
