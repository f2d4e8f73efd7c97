"""Operators over gameplay events: per-run features, point-in-time windows, training records."""
