"""Measures over a commit history, its events and its people; each takes frames and returns a DataFrame."""
