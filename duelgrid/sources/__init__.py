"""Readers of arenas, instruction sets and model outputs, normalised to declared columns."""
