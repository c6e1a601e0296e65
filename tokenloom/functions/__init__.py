"""Filled in module by module."""
