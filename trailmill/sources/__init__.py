"""Readers and writers of datasets and annotations."""
