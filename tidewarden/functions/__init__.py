"""Column expressions: text, scores, contract checks and session clock."""
