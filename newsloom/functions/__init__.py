"""Newsloom functions."""
