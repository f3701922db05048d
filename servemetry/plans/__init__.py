"""The registered queries: views of the given tables, jobs, and their SQL twins."""
