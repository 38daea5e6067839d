"""Registered queries, their DuckDB oracles, output shaping and plan inspection."""
