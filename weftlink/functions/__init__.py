"""Column functions: text normalisation, blocking keys, id lists, string similarity."""
