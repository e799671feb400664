"""Tokenizer for marked-up text, with character offsets and tags, as Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

SPLITS = frozenset([*map(chr, range(33)), *';"&/:!#?$%()@^*+-,=><[]{}|`~_'])
MAX_BYTES = 100
IGNORED = ("style", "script")
_CLOSING = {t: re.compile(f"</{t}", re.I) for t in IGNORED}

TAG = StructType([
    StructField("name", StringType()), StructField("attributes", MapType(StringType(), StringType())), StructField("begin", IntegerType()),
    StructField("end", IntegerType()), StructField("char_begin", IntegerType()), StructField("char_end", IntegerType()),
])
DOCUMENT = StructType([
    StructField("terms", ArrayType(StringType())), StructField("term_char_begin", ArrayType(IntegerType())),
    StructField("term_char_end", ArrayType(IntegerType())), StructField("tags", ArrayType(TAG)),
])


@dataclass
class Tag:
    name: str
    attributes: dict[str, str]
    begin: int
    end: int
    char_begin: int
    char_end: int


@dataclass
class Document:
    terms: list[str] = field(default_factory=list)
    term_char_begin: list[int] = field(default_factory=list)
    term_char_end: list[int] = field(default_factory=list)
    tags: list[Tag] = field(default_factory=list)


def normalised(token: str) -> list[tuple[str, int]]:
    """(term, offset in the token) of one token: lower case, no apostrophes, dotted tokens resolved."""
    plain = token.lower().replace("'", "")
    if "." not in plain:
        return [(plain, 0)]
    lead = len(plain) - len(plain.lstrip("."))
    core = plain.strip(".")
    if "." not in core:
        return [(core, lead)]
    if all(c == "." for c in core[1::2]):
        return [(core.replace(".", ""), lead)]
    # one-character pieces before the last one are dropped, as in ph.d -> ph d but 3.14 -> 14
    out, at = [], lead
    pieces = core.split(".")
    for k, piece in enumerate(pieces):
        if len(piece) > 1 or (k == len(pieces) - 1 and piece):
            out.append((piece, at))
        at += len(piece) + 1
    return out


class Tokenizer:
    """State of one text."""

    def __init__(self, text: str):
        self.text = text
        self.doc = Document()
        self.open: list[tuple[str, dict[str, str], int, int, bool]] = []
        self.closed: list[Tag] = []
        self.muted = 0

    def emit(self, start: int, end: int) -> None:
        if start >= end or self.muted:
            return
        token = self.text[start:end]
        for term, at in normalised(token):
            if not term.strip() or len(term.encode()) >= MAX_BYTES:
                continue
            whole = "." not in token
            self.doc.terms.append(term)
            self.doc.term_char_begin.append(start if whole else start + at)
            self.doc.term_char_end.append(end if whole else min(end, start + at + len(term) + (token.count(".") if len(normalised(token)) == 1 and "." in token.strip(".") else 0)))

    def run(self) -> None:
        text, n = self.text, len(self.text)
        at = start = 0
        while at < n:
            c = text[at]
            if c not in SPLITS:
                at += 1
                continue
            self.emit(start, at)
            if c == "<":
                at = self.markup(at)
            elif c == "&":
                at = self.entity(at)
            else:
                at += 1
            start = at
        self.emit(start, n)
        for name, attributes, begin, char_begin, _ in self.open:
            self.closed.append(Tag(name, attributes, begin, begin, char_begin, char_begin))

    def entity(self, at: int) -> int:
        end = at + 1
        while end < len(self.text) and (self.text[end] in "#" or (self.text[end].isascii() and (self.text[end].isdigit() or self.text[end].islower()))):
            end += 1
        return end + 1 if end < len(self.text) and self.text[end] == ";" else at + 1

    def past(self, what: str, at: int) -> int:
        found = self.text.find(what, at)
        return len(self.text) if found < 0 else found + len(what)

    def markup(self, at: int) -> int:
        follows = self.text[at + 1 : at + 2]
        if not follows:
            return len(self.text)
        if follows == "/":
            return self.end_tag(at)
        if follows == "!":
            return self.past("-->", at) if self.text.startswith("<!--", at) else self.past(">", at)
        if follows == "?":
            return self.past("?>", at)
        return self.begin_tag(at)

    def end_tag(self, at: int) -> int:
        end = self.past(">", at)
        name = self.text[at + 2 : end].rstrip(">").split()
        name = name[0].lower() if name else ""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                self.close(k, at)
                break
        return end

    def close(self, k: int, char_end: int) -> None:
        name, attributes, begin, char_begin, mutes = self.open.pop(k)
        self.muted -= mutes
        self.closed.append(Tag(name, attributes, begin, len(self.doc.terms), char_begin, char_end))

    def begin_tag(self, at: int) -> int:
        text, n = self.text, len(self.text)
        k = at + 1
        while k < n and not text[k].isspace() and text[k] != ">" and not text.startswith("/>", k):
            k += 1
        name = text[at + 1 : k].lower()
        attributes: dict[str, str] = {}
        closed = False
        while k < n and text[k] != ">":
            if text[k].isspace():
                k += 1
            elif text.startswith("/>", k):
                closed = True
                k += 1
            else:
                k = self.attribute(k, attributes)
        k = min(k + 1, n)
        toggle = attributes.get("tokenizetagcontent", "true").lower() == "false"
        mutes = not closed and (name in IGNORED or toggle)
        if name in IGNORED and not closed:
            # what is inside isn't markup either
            found = _CLOSING[name].search(text, k)
            end = found.start() if found else n
            self.open.append((name, attributes, len(self.doc.terms), k, False))
            return end
        self.open.append((name, attributes, len(self.doc.terms), k, mutes))
        self.muted += mutes
        if closed:
            self.close(len(self.open) - 1, k)
        return k

    def attribute(self, k: int, attributes: dict[str, str]) -> int:
        text, n = self.text, len(self.text)
        start = k
        while k < n and not text[k].isspace() and text[k] not in "=>" and not text.startswith("/>", k):
            k += 1
        key, value = text[start:k].lower(), ""
        if k < n and text[k] == "=":
            k += 1
            if k < n and text[k] in "\"'":
                end = text.find(text[k], k + 1)
                end = n if end < 0 else end
                value, k = text[k + 1 : end], min(end + 1, n)
            else:
                start = k
                while k < n and not text[k].isspace() and text[k] != ">" and not text.startswith("/>", k):
                    k += 1
                value = text[start:k]
        if key:
            attributes[key] = value
        return k if k > start else k + 1


def tokenize(text: str, tags: Iterable[str] = ()) -> Document:
    """Terms with character offsets, and the tags of the given names, by begin and then the longest first."""
    state = Tokenizer(text)
    state.run()
    wanted = set(tags)
    state.doc.tags = sorted((t for t in state.closed if t.name in wanted), key=lambda t: (t.begin, -t.end))
    return state.doc


def tokenize_to_terms(text: str) -> list[str]:
    return tokenize(text).terms


#: Characters of text whose tokens are Python objects at a time.
SLICE = 1 << 18


def _slices(texts: pa.Array, missing: str | None = "") -> Iterator[list[str | None]]:
    """Texts in order, in lists of about SLICE characters."""
    out, size = [], 0
    for t in texts:
        out.append(missing if not t.is_valid else t.as_py())
        size += len(out[-1] or "") + 1
        if size >= SLICE:
            yield out
            out, size = [], 0
    if out:
        yield out


def _plain(doc: Document) -> dict:
    return vars(doc) | {"tags": [vars(t) | {"attributes": list(t.attributes.items())} for t in doc.tags]}


def markup_terms(text: Column | str) -> Column:
    """Terms of marked-up text."""

    @F.arrow_udf(ArrayType(StringType()))
    def terms(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.string())
        for s in texts:
            yield pa.concat_arrays([pa.array([None if t is None else tokenize_to_terms(t) for t in part], kind) for part in _slices(s, None)] or [pa.array([], kind)])

    return terms(F.col(text) if isinstance(text, str) else text)


def markup_document(text: Column | str, tags: Iterable[str] = ()) -> Column:
    """Terms, offsets and tags of marked-up text."""
    names = tuple(tags)

    @F.arrow_udf(DOCUMENT)
    def documents(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = to_arrow_type(DOCUMENT)
        for s in texts:
            # objects of a slice are Arrow arrays before those of the next one are made
            yield pa.concat_arrays([pa.array([_plain(tokenize(t, names)) for t in part], kind) for part in _slices(s)] or [pa.array([], kind)])

    return documents(F.col(text) if isinstance(text, str) else text)
