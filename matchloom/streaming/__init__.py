"""Incremental forms of the row-wise stages, for records that keep arriving."""
