"""Small pure helpers on single values."""
