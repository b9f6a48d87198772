"""Column functions: values (numbers, dates, keys) and texts (titles, layouts, fingerprints)."""
