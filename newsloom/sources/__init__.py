"""Newsloom sources."""
