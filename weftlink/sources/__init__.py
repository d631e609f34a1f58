"""Readers and writers of entity tables, truth lists, id lists and results."""
