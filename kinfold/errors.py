"""Errors that name the input at fault."""


class InputError(ValueError):
    """An input or a parameter breaks its contract."""


class IntegrityError(RuntimeError):
    """Relations contradict each other."""
