"""Multi-step flows and the query catalog with its DuckDB counterparts."""
