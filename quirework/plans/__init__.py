"""Whole plans: the fixed-format plan, and the catalogue of queries over the driver's tables."""
