"""Continuous scans, live reports and alerts with Structured Streaming."""
