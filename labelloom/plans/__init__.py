"""Flows: named steps over lazy values."""
