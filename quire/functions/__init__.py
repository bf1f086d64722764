"""Column functions and the vocabulary they use."""
