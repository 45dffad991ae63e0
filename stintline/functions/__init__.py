"""Column functions: conversions, seeded random numbers, small closed formulas."""
