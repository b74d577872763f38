"""Column expressions shared by batch jobs and streaming queries."""
