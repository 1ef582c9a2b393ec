"""Where declaration rows come from."""
