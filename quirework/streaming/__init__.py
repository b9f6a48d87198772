"""Records of page streams."""
