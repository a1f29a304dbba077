"""Column functions: rigid matrices, text keys, score arithmetic."""
