"""Outcome models per archetype, and the offers made from their scores."""
