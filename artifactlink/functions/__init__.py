"""Column functions: similarity, text forms and predicates. All are built-in expressions, so they stay in whole-stage code."""
