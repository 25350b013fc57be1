"""DataFrame operators of the fact engine."""
