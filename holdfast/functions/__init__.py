"""Column expressions shared by the operators; nothing here runs a job."""
