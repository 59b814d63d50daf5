"""Column functions and model adapters."""
