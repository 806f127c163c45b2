"""Column functions: every helper takes and returns columns."""
