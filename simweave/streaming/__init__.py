"""Folders that keep growing."""
