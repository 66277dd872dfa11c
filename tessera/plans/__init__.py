"""Registered queries: each operator on the driver's tables, beside the same result in SQL."""
