"""Errors of the engine."""


class FolioError(Exception):
    pass


class UndeclaredReference(FolioError):
    """A join over a field that no reference or dictionary declares."""


class DanglingReference(FolioError):
    """A strict join or write met a key without a target."""


class RowCeiling(FolioError):
    """A join side or a number of groups is beyond its ceiling."""


class IndexRequired(FolioError):
    """A lazy query touches a field without an index."""


class PeriodClosed(FolioError):
    """A write falls into a closed period."""


class VersionConflict(FolioError):
    """A compare-and-set write expected another version."""


class LocaleMissing(FolioError):
    """No label in the locale or its fallbacks."""
