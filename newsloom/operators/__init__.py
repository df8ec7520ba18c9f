"""Newsloom operators."""
