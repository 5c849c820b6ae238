"""Errors of the engine. Missing names raise KeyError, wrong types TypeError, missing features NotImplementedError."""


class Invalid(ValueError):
    """A plan or its input breaks an operator's contract."""


class CapacityError(Invalid):
    """An input is larger than an operator can address."""
