"""Subpackage of lexmill."""
