"""DataFrame-to-DataFrame operators. None reads a path or the clock by itself."""
