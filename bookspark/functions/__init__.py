"""Shared column expressions (text, numbers, dates)."""
