"""Subpackage of tallyloom."""
