"""Exceptions of the public interface."""


class Error(Exception):
    """Any of them."""


class InvalidAttr(Error):
    """A column that the relation doesn't have."""


class InvalidObject(Error):
    """An object without a usable type."""


class StixPatternError(Error):
    """A pattern that can't be parsed or translated."""


class InvalidViewname(Error):
    """A name that isn't an identifier."""


class InvalidStixPath(Error):
    """A path that isn't an object path or property name."""


class IncompatibleType(Error):
    """Views of different object types."""


class UnknownViewname(Error):
    """No view or table of that name."""


class DuplicateTable(Error):
    """A table of that name exists."""


class UnexpectedError(Error):
    """Anything the engine below reports that has no class of its own."""


class DatabaseMismatch(Error):
    """A stored session of another version."""

    def __init__(self, found: str, expected: str):
        super().__init__(f"found version {found}, expected {expected}")


class SessionNotFound(Error):
    """No session of that name to attach to."""


class SessionExists(Error):
    """A session of that name exists."""


class InvalidComparisonOperator(Error):
    """Not one of the comparison operators, or not with that operand."""


class InvalidPredicateOperator(Error):
    """Not AND or OR."""


class InvalidPredicateOperand(Error):
    """AND and OR take predicates."""


class InvalidJoinOperator(Error):
    """Not a kind of join."""


class InvalidAggregateFunction(Error):
    """Not an aggregate function."""


class InvalidQuery(Error):
    """Stages that don't make a query."""
