"""Operators over preference records."""
