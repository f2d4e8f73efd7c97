"""Structured Streaming: the per-run profile with timers, and the jobs around it."""
