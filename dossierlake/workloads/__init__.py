"""The registered queries, their input projections and their DuckDB counterparts."""
