"""Column expressions: text repair, tag parsing, number formatting."""
