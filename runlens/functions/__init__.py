"""Column expressions: vectors, payload access, effects, texts and messages."""
