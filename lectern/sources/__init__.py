"""Readers of markup archives, layout exports, page text, cases and structures."""
