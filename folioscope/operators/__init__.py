"""Relational operators: nesting, integrity, resolution, verification."""
