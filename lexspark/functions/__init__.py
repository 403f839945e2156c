"""Column functions and pure text helpers."""
