"""Telemetry derived from the test tables, and the queries that run on it."""
