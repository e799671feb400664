"""Errors of the engine."""

from __future__ import annotations


class LexloomError(Exception):
    """Base of all errors; ``context`` says where it happened, outermost first."""

    def __init__(self, message: str, *context: str):
        super().__init__(message)
        self.message = message
        self.context = list(context)

    def with_context(self, where: str) -> LexloomError:
        self.context.insert(0, where)
        return self

    def __str__(self) -> str:
        return ": ".join([*self.context, self.message])


class QueryValidationError(LexloomError):
    """A query has faults; ``faults`` has all of them, in pre-order."""

    def __init__(self, faults: list):
        super().__init__("; ".join(map(str, faults)))
        self.faults = list(faults)


class MissingFieldError(LexloomError):
    """The index has no such field."""


class UnknownStemmerError(LexloomError):
    """No stemmer has that name."""


class UnknownIndexPartError(LexloomError):
    """A field or file name can't be read as a part of an index."""


class BadFormatError(LexloomError):
    """Bytes aren't what their format prescribes."""


class KeyTooLongError(LexloomError):
    """A key exceeds what the store can hold."""
