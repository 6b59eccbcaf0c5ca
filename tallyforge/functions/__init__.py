"""Column expressions shared by operators and readers."""
