"""Column expressions shared by the table jobs."""
