"""Operators over declaration rows."""
