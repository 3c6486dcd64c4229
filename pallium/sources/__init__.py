"""Readers: tables, HTML pages, label files."""
