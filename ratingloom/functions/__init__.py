"""Column expressions and join/rank building blocks shared by the operators."""
