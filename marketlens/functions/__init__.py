"""marketlens."""
