"""Where bars come from."""
