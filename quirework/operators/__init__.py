"""Operators over page rows: evidence, grouping, folding, validation, repair, splitting, sampling and flattening."""
