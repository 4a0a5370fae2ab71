"""Where findings go: tables, reports, alert payloads."""
