"""Column functions: classification rules, observations and ordering."""
