"""Errors that a caller can act on."""


class ScanError(Exception):
    """Base of all errors of this package."""


class ConfigError(ScanError):
    """The configuration is invalid; the message lists every problem."""


class RuleError(ScanError):
    """A rule file is invalid."""


class TargetError(ScanError):
    """What should be scanned is not there, or is no git checkout where one is needed."""
