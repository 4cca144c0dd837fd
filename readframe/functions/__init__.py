"""Column expressions: they take and return Columns and never start a job."""
