"""The operators applied to the shared test tables, with their SQL twins."""
