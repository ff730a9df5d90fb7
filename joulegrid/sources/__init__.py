"""Where samples and events come from."""
