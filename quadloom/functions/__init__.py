"""Column functions: expressions, colours, tile addresses."""
