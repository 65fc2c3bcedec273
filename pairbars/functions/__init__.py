"""Windows and guarded expressions."""
