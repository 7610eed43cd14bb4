"""Queries registered for the driver, each next to its equivalent SQL."""
