"""Reading observations and writing results."""
