"""Planners that run on the driver."""
