"""Column expressions: SQL templates, response JSON, labels."""
