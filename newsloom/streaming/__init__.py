"""Newsloom streaming."""
