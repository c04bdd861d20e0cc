"""Readers and writers: JSON lines, CSV, HTML, event streams, Markdown, packaged training rows."""
