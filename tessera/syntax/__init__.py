"""Syntax trees of source texts."""
