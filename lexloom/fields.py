"""Names of index fields: a stemmed view of a field is a field of its own."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import UnknownIndexPartError, UnknownStemmerError

DEFAULT_FIELD = "document"
_STEMMERS = {"": "", "null": "", "nullstemmer": "", "krovetz": "krovetz", "krovetzstemmer": "krovetz", "porter": "porter", "porter2stemmer": "porter"}


def stemmer_name(name: str) -> str:
    """'' (none), 'krovetz' or 'porter' for a short name or a class name."""
    found = _STEMMERS.get(name.rsplit(".", 1)[-1].lower())
    if found is None:
        raise UnknownStemmerError(name)
    return found


@dataclass(frozen=True, order=True)
class Field:
    """A field and the stemmer its terms went through ('' for none)."""

    name: str = DEFAULT_FIELD
    stemmer: str = ""

    @classmethod
    def parse(cls, text: str | None) -> Field:
        """From a query: nothing, ``name``, ``name.stemmer``, or a file name."""
        if text is None or text == DEFAULT_FIELD:
            return cls()
        if text.startswith(("field.", "postings")):
            return cls.of_file(text)
        name, *rest = text.split(".")
        if not rest:
            return cls(name)
        if len(rest) > 1:
            raise UnknownIndexPartError(text)
        return cls(name, stemmer_name(rest[0]))

    @classmethod
    def of_file(cls, text: str) -> Field:
        """From the name of a postings file."""
        kind, *rest = text.split(".")
        if kind == "postings" and len(rest) < 2:
            return cls(DEFAULT_FIELD, stemmer_name(rest[0]) if rest else "")
        if kind == "field" and len(rest) == 1:
            return cls(rest[0])
        if kind == "field" and len(rest) == 2 and rest[0] in ("krovetz", "porter"):
            return cls(rest[1], rest[0])
        raise UnknownIndexPartError(text)
