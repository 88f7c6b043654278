"""Event-time KPIs, the same code for a stream and for a table."""
