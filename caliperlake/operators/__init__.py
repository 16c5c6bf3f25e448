"""Operators over inspection tables."""
