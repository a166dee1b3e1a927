"""Readers and writers: corpora, word lists, token maps, artifacts."""
