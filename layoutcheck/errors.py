"""Errors of the engine."""


class LayoutError(Exception):
    """Any error that this package raises itself."""


class OpenFileError(LayoutError):
    """A file or directory can't be read."""

    def __init__(self, path: str, reason: str = ""):
        super().__init__(f"cannot open {path}" + (f": {reason}" if reason else ""))
        self.path = path


class InvalidFileError(LayoutError):
    """A file's content breaks its format."""


class HierarchyError(LayoutError):
    """References that lead nowhere, no top cell, or nesting that an operator does not support."""


class RuleError(LayoutError):
    """A rule that can't be run as written."""


class NotImplementedRule(RuleError, NotImplementedError):
    """A rule kind without a check."""
