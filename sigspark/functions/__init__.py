"""sigspark."""
