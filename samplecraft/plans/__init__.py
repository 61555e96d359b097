"""End-to-end plans over the driver tables: fixtures derived from them and the
registered queries (Spark side and DuckDB oracle side)."""
