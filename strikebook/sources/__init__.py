"""Readers and writers: exports, documents, single-byte files, snapshots, artifacts."""
