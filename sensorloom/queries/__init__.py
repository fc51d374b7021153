"""The operators applied to the driver's tables, with SQL for the same rows."""
