"""Readers, writers, document predicates and the dataset catalogue."""
