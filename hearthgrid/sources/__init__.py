"""Reading, writing and fixed dimension tables."""
