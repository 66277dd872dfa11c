"""Column functions: each takes columns or literals and returns a Column."""
