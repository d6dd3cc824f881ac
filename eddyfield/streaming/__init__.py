"""Recordings that are still being written."""
