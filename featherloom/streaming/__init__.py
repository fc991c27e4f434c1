"""Continuously refreshed model monitoring."""
