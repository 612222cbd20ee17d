"""Readers and writers: text formats and table adapters."""
