"""Column expressions, all in float32 where the semantics ask for it."""
