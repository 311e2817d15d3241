"""Readers that turn files into engine tables, and the report sinks."""
