"""Readers and writers of record, truth and set files."""
