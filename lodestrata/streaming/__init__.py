"""The event measures on streams."""
