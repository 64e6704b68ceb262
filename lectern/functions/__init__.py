"""Column expressions: text, references, references lists."""
