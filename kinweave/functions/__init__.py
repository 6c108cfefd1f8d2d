"""Column functions: text, addresses, similarities."""
