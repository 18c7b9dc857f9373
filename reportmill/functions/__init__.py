"""Column expressions over texts and class sets."""
