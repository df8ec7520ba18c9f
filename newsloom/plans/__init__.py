"""Newsloom plans."""
