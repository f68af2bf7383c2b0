"""Readers and writers of the audit."""
