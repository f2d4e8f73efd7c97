"""Game-telemetry features, training records and offers on Spark tables and streams."""
