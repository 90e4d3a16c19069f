"""Reading raw inputs and storing intermediate tables."""
