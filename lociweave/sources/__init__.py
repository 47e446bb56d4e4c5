"""Readers and writers of genomic text formats."""
