"""Column expressions: each function takes and returns Columns and stays inside Catalyst."""
