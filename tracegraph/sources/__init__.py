"""Readers and writers of trace artifacts."""
