"""Incremental intake of observation files."""
