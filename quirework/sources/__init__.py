"""Sources: page rows out of binary files, and page rows out of the driver's tables."""
