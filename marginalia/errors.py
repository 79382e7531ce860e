"""Errors that callers are expected to handle."""


class InvalidRequest(ValueError):
    """The request cannot be answered as it is."""


class NotFound(LookupError):
    """What was asked for does not exist."""


class Unavailable(RuntimeError):
    """Something that the answer needs is not there yet."""
