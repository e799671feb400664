"""Block B-tree index files: footer, JSON manifest, block directory and prefix-coded blocks.

A file holds its values itself, or, as ``split.keys`` in a folder, points to numbered
sibling files.  What the values mean depends on the reader class that the manifest names.
"""

from __future__ import annotations

import json
import mmap
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import pyarrow as pa

from ..errors import BadFormatError, UnknownIndexPartError
from ..fields import Field, stemmer_name
from .streams import Cursor, text

MAGIC = 0x1A2B3C4D5E6F7A8D
VALUE_MAGIC = 0x2B3C4D5E6F7A8B9C
FOOTER = 28
SPLIT_KEYS = "split.keys"

#: Parts of an index by the last component of the reader's class name.
PARTS = {"DiskNameReader": "names", "DiskNameReverseReader": "names.reverse", "CorpusReader": "corpus", "DiskLengthsReader": "lengths", "PositionIndexReader": "positions"}

SNAPPY_STREAM = b"\x82SNAPPY\x00\x00\x00\x00\x01\x00\x00\x00\x01"


def part_of(reader_class: str) -> str:
    """Which part of an index a reader class reads."""
    found = PARTS.get(reader_class.rsplit(".", 1)[-1])
    if found is None:
        raise UnknownIndexPartError(reader_class)
    return found


def keys_path(path: str | Path) -> Path:
    p = Path(path)
    return p / SPLIT_KEYS if p.is_dir() else p


def _open(path: Path, magic: int) -> memoryview:
    with path.open("rb") as f:
        size = path.stat().st_size
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if size else b""
    view = memoryview(data)
    if size < 8 or int.from_bytes(view[-8:], "big") != magic:
        raise BadFormatError(f"{path}: no such magic number at its end")
    return view


def is_btree(path: str | Path) -> bool:
    p = keys_path(path)
    if not p.is_file() or p.stat().st_size < FOOTER:
        return False
    with p.open("rb") as f:
        f.seek(-8, 2)
        return int.from_bytes(f.read(8), "big") == MAGIC


@dataclass(frozen=True)
class Block:
    first_key: bytes
    begin: int
    header: int
    end: int


class BTree:
    """An open B-tree file."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.split = self.path.is_dir() or self.path.name == SPLIT_KEYS
        self.data = _open(keys_path(path), MAGIC)
        footer = Cursor(self.data, len(self.data) - FOOTER)
        vocabulary, manifest = footer.number(">Q"), footer.number(">Q")
        self.block_size = footer.number(">I")
        self.manifest: dict = json.loads(bytes(self.data[manifest : len(self.data) - FOOTER]))
        at = Cursor(self.data, vocabulary, manifest)
        at.take(at.number(">I"))
        heads = []
        while not at.eof():
            heads.append((at.take(at.vbyte()), at.vbyte(), at.vbyte()))
        ends = [h[1] for h in heads[1:]] + [vocabulary]
        self.blocks = [Block(k, b, h, e) for (k, b, h), e in zip(heads, ends, strict=True)]
        self._first_keys = [b.first_key for b in self.blocks]
        self._values: dict[int, memoryview] = {}

    @cached_property
    def part(self) -> str:
        return part_of(self.manifest["readerClass"])

    def block_items(self, block: Block) -> Iterator[tuple[bytes, bytes]]:
        """All keys of a block with their values."""
        at = Cursor(self.data, block.begin, block.begin + block.header)
        count = at.number(">Q")
        key = at.take(at.vbyte())
        start, end = block.begin + block.header, block.end - at.vbyte()
        yield key, self._value(start, end)
        for _ in range(count - 1):
            common, size = at.vbyte(), at.vbyte()
            key = key[:common] + at.take(size - common)
            start, end = end, block.end - at.vbyte()
            yield key, self._value(start, end)

    def _value(self, start: int, end: int) -> bytes:
        raw = bytes(self.data[start:end])
        if not self.split:
            return raw
        at = Cursor(raw)
        file, offset, size = at.number(">I"), at.number(">Q"), at.number(">Q")
        if file not in self._values:
            folder = keys_path(self.path).parent
            self._values[file] = _open(folder / str(file), VALUE_MAGIC)
        return bytes(self._values[file][offset : offset + size])

    def find(self, key: bytes | str) -> bytes | None:
        wanted = key.encode() if isinstance(key, str) else key
        k = bisect_right(self._first_keys, wanted) - 1
        if k < 0:
            return None
        for have, value in self.block_items(self.blocks[k]):
            if have == wanted:
                return value
            if have > wanted:
                return None
        return None

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        for b in self.blocks:
            yield from self.block_items(b)

    def keys(self) -> list[str]:
        return [text(k) for k, _ in self.items()]

    def name_to_id(self) -> dict[str, int]:
        if self.part != "names.reverse":
            raise BadFormatError(f"{self.path} maps no names to ids")
        return {text(k): int.from_bytes(v, "big") for k, v in self.items()}


# values


@dataclass(frozen=True)
class LengthTable:
    documents: int
    nonzero: int
    collection_length: int
    average: float
    longest: int
    shortest: int
    first: int
    last: int
    values: tuple[int, ...] = field(repr=False, default=())

    def count(self, doc_id: int) -> int:
        """The length of a document, 0 outside the table."""
        k = doc_id - self.first
        return self.values[k] if 0 <= k < len(self.values) else 0


def read_lengths(value: bytes) -> LengthTable:
    at = Cursor(value)
    head = [at.number(">Q"), at.number(">Q"), at.number(">Q"), at.number(">d"), at.number(">Q"), at.number(">Q"), at.number(">Q"), at.number(">Q")]
    n = (len(value) - at.at) // 4
    return LengthTable(*head, tuple(at.number(">I") for _ in range(min(n, head[7] - head[6] + 1))))


@dataclass(frozen=True)
class Posting:
    doc_id: int
    tf: int
    positions: tuple[int, ...] = ()


HAS_SKIPS, HAS_MAX, HAS_INLINING = 1, 2, 4


def read_postings(value: bytes, level: str = "Positions") -> tuple[int, int, list[Posting]]:
    """(document frequency, collection frequency, postings) down to a level of detail."""
    at = Cursor(value)
    options = at.vbyte()
    inline = at.vbyte() if options & HAS_INLINING else None
    df, cf = at.vbyte(), at.vbyte()
    if options & HAS_MAX:
        at.vbyte()
    if options & HAS_SKIPS:
        for _ in range(3):
            at.vbyte()
    sizes = [at.vbyte() for _ in range(3)]
    if options & HAS_SKIPS:
        at.vbyte()
        at.vbyte()
    streams, begin = [], at.at
    for size in sizes:
        streams.append(Cursor(value, begin, begin + size))
        begin += size
    docs, counts, places = streams
    out, doc = [], 0
    for _ in range(df):
        doc += docs.vbyte()
        tf = counts.vbyte() if level != "Docs" else 1
        own: list[int] = []
        if level == "Positions":
            if inline is not None and tf > inline:
                places.vbyte()
            p = 0
            for _ in range(tf):
                p += places.vbyte()
                own.append(p)
        out.append(Posting(doc, tf, tuple(own)))
    return df, cf, out


@dataclass(frozen=True)
class CorpusDocument:
    metadata: tuple[tuple[str, str], ...]
    text: str


def read_document(value: bytes) -> CorpusDocument:
    """A stored document: framed Snappy with big-endian lengths inside."""
    if not value.startswith(SNAPPY_STREAM):
        raise BadFormatError("no Snappy stream header")
    body = value[len(SNAPPY_STREAM) + 4 :]
    size = shift = 0
    for b in body:
        size |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            break
    try:
        at = Cursor(pa.decompress(body, size, "snappy", asbytes=True))
    except OSError as e:
        raise BadFormatError(f"bad Snappy data: {e}") from e
    string = lambda: text(at.take(at.number(">I")))
    at.take(8)
    at.number(">Q")
    string()
    metadata = tuple((string(), string()) for _ in range(at.number(">I")))
    return CorpusDocument(metadata, string())


# a whole index


@dataclass
class IndexFolder:
    """The parts of an index folder."""

    lengths: BTree
    names: BTree
    names_reverse: BTree
    corpus: BTree | None
    postings: dict[Field, BTree]


def open_folder(path: str | Path) -> IndexFolder:
    """Open every B-tree of a folder and check that the parts are what an index has."""
    single: dict[str, list[BTree]] = {p: [] for p in PARTS.values() if p != "positions"}
    postings: dict[Field, BTree] = {}
    for entry in sorted(Path(path).iterdir()):
        if not is_btree(entry):
            continue
        tree = BTree(entry)
        if tree.part != "positions":
            single[tree.part].append(tree)
            continue
        f = Field.of_file(entry.name)
        declared = stemmer_name(tree.manifest.get("stemmer") or "")
        if declared != f.stemmer:
            raise BadFormatError(f"{entry}: its name says stemmer {f.stemmer!r}, its manifest {declared!r}")
        postings[f] = tree
    for part, found in single.items():
        if len(found) > 1 or not found and part != "corpus":
            raise BadFormatError(f"{path}: {len(found)} parts of kind {part}")
    return IndexFolder(single["lengths"][0], single["names"][0], single["names.reverse"][0], single["corpus"][0] if single["corpus"] else None, postings)
