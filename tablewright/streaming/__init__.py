"""Continuous inputs: a folder's new files, cleaned by a recipe and appended, and counts per window of time."""
