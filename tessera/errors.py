"""Errors that callers can tell apart."""


class TesseraError(Exception):
    """Base of all errors raised on purpose."""


class RoleColumnError(TesseraError):
    """A role names a column that the table does not have."""


class ConcatDataError(TesseraError):
    """Something other than a RoleFrame was appended."""


class ConcatBackendError(TesseraError):
    """Tables of two Spark sessions were appended."""


class SpaceError(TesseraError):
    """An unknown space of an experiment context."""


class NoColumnsError(TesseraError):
    """No column has the role that is asked for."""


class NotSuitableFieldError(TesseraError):
    """A grouping, target or baseline column cannot be compared."""


class NotFoundInContextError(TesseraError):
    """A result was asked for that no operator has stored."""


class AbstractMethodError(TesseraError, NotImplementedError):
    """A method that a subclass has to define."""


class DataTypeError(TesseraError):
    """An operand has the wrong type."""


class BackendTypeError(TesseraError):
    """Tables of two Spark sessions meet in one operation."""


class MergeOnError(TesseraError):
    """A join key is missing."""


class NoRequiredArgumentError(TesseraError):
    """An argument without which the operation is undefined, such as an order, is missing."""


class NoneArgumentError(TesseraError):
    """An argument must not be None here."""


class InvalidArgumentError(TesseraError):
    """An argument has a value outside its domain."""


class PairsNotFoundError(TesseraError):
    """Matching found no pair."""
