"""DataFrame -> DataFrame operators (see README's coverage table for IDs)."""
