"""Queries registered with the driver."""
