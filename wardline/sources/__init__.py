"""Telemetry tables and files -> EVENT rows that concern a known service."""
