"""Column expressions and staged projections; nothing here triggers a job."""
