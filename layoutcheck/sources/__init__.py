"""Reading and writing layouts and violations."""
