"""Column functions: no function here starts a job or looks at data."""
