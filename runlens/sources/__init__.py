"""Readers of event topics, landed files, the record lake and seed rows."""
