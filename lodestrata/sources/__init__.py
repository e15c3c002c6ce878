"""Readers and writers of histories, exports and declarations."""
