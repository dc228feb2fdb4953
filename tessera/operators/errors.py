"""Errors of queries."""


class RelError(Exception):
    """A query can't be planned, or its result isn't what was asked for."""


class PlacementError(RelError):
    """A step stands where it may not."""
