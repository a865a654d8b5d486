"""Readers, writers and codecs of documents and archives."""
