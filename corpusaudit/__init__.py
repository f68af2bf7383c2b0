"""Corpus-scale web-site auditing as plain DataFrame -> DataFrame operators."""
