"""Training-data operators: everything here is self-contained and optional."""
