"""Column expressions: text folding, guarded arithmetic, keyword rules, display formats."""
