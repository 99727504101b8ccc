"""Registered queries and their DuckDB formulations."""
