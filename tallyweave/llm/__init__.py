"""Operators for building training data, each in a module of its own; ``queries`` registers them."""
