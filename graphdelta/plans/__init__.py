"""Registered end-to-end queries over the driver tables and their DuckDB oracles."""
