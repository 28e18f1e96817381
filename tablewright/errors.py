"""Errors raised by the library."""


class TablewrightError(Exception):
    """Base class; ``details`` carries the facts behind the message."""

    def __init__(self, message: str, details: dict | None = None):
        super().__init__(message)
        self.details = details or {}


class ReadError(TablewrightError):
    pass


class WriteError(TablewrightError):
    pass


class CleanError(TablewrightError):
    pass


class CheckError(TablewrightError):
    """An asserted property of a table does not hold."""


class ProfileError(TablewrightError):
    pass


class PrepareError(TablewrightError):
    pass


class ChartError(TablewrightError):
    pass
