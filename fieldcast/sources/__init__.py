"""Readers and parsers for station files, forecast and alert documents and declared tables."""
