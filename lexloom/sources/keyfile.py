"""Keyed record files: a header block of 4 KiB, index blocks of several levels, and records.

All levels hold (key, pointer) entries behind a shared prefix; leaves hold records inline or
point to where they lie.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from ..errors import BadFormatError, KeyTooLongError, MissingFieldError
from .streams import Cursor, text

BLOCK = 4096
HEADER = 28
MARKER = 32472
MAX_KEY, N_INDEX, N_LEVEL, N_SEGMENT = 512, 3, 32, 127
UNIT = 8

Address = tuple[int, int]
NULL: Address = (N_SEGMENT, 0)


def encode_int(number: int) -> bytes:
    """Six bytes of six bits each, none of them zero, that sort like the numbers."""
    return bytes((number >> (6 * k) & 0x3F) | 0x40 for k in range(5, -1, -1))


def decode_int(key: bytes) -> int:
    value = 0
    for b in key:
        value = value << 6 | b & 0x3F
    return value


@dataclass(frozen=True)
class Page:
    address: Address
    count: int
    level: int
    next: Address
    prefix: bytes
    keys: memoryview

    def entry(self, k: int) -> tuple[bytes, Cursor]:
        """The key of an entry without the prefix, and a cursor at what follows it."""
        at = Cursor(self.keys, struct.unpack_from(">H", self.keys, 2 * k)[0])
        return at.take(at.big_vbyte()), at

    def search(self, key: bytes) -> tuple[int, bool]:
        """The first entry that isn't smaller, and whether it is the key."""
        head = key[: len(self.prefix)]
        if head != self.prefix:
            return (0 if head < self.prefix else self.count), False
        rest = key[len(self.prefix) :]
        lo, hi = 0, self.count
        while lo < hi:
            mid = (lo + hi) // 2
            if self.entry(mid)[0] < rest:
                lo = mid + 1
            else:
                hi = mid
        return lo, lo < self.count and self.entry(lo)[0] == rest


class Keyfile:
    """An open key file with its further segments (``path``, ``path.1``, ...)."""

    def __init__(self, path: str | Path):
        first = Path(path)
        head = Cursor(first.read_bytes())
        if error := head.number(">I"):
            raise BadFormatError(f"{path}: error code {error}")
        version, minor = head.number(">I"), head.number(">I")
        if version != 7 or minor != 0:
            raise BadFormatError(f"{path}: version {version}.{minor}")
        n = head.number(">I")
        self.segments = [memoryview(head.data), *(memoryview(first.with_name(f"{first.name}.{k}").read_bytes()) for k in range(1, n))]
        self.levels = [head.number(">I") for _ in range(N_INDEX)]
        if (marker := head.number(">I")) != MARKER:
            raise BadFormatError(f"{path}: marker {marker}")
        if not head.number(">I"):
            raise BadFormatError(f"{path}: not closed properly")
        table = lambda: [[self._address(head) for _ in range(N_INDEX)] for _ in range(N_LEVEL)]
        table()
        self.first, self.last = table(), table()
        head.number(">Q")
        head.take(8 * N_SEGMENT)
        self.inline = head.number(">I")

    @staticmethod
    def _address(at: Cursor) -> Address:
        return at.number(">H"), at.number(">Q")

    def page(self, address: Address) -> Page:
        segment, block = address
        data = self.segments[segment][block * BLOCK : (block + 1) * BLOCK]
        if len(data) < BLOCK:
            raise BadFormatError(f"no block {block} in segment {segment}")
        at = Cursor(data)
        count = at.number(">H")
        at.number(">H")
        at.take(1)
        prefix_size = at.take(1)[0]
        at.take(1)
        level = at.take(1)[0]
        following = self._address(at)
        self._address(at)
        keys = data[HEADER:]
        # the prefix lies at the very end of the block
        prefix = bytes(keys[len(keys) - prefix_size :]) if prefix_size else b""
        return Page(address, count, level, following, prefix, keys)

    def _leaf(self, key: bytes) -> Page | None:
        level = self.levels[0]
        address = self.first[level][0]
        while True:
            page = self.page(address)
            if page.level == 0:
                return page
            k, _ = page.search(key)
            if k < page.count:
                at = page.entry(k)[1]
                raw = at.big_vbyte()
                address = (at.big_vbyte() if raw & 1 else 0), raw >> 1
            elif page.next == NULL:
                address = self.last[page.level][0]
            else:
                return None
            if address == NULL:
                return None

    def _record(self, page: Page, k: int) -> bytes:
        at = page.entry(k)[1]
        size = at.big_vbyte()
        if size <= self.inline:
            return at.take(size)
        raw = at.big_vbyte()
        segment = at.big_vbyte() if raw & 1 else 0
        start = (raw >> 1) * UNIT
        return bytes(self.segments[segment][start : start + size])

    def lookup(self, key: bytes | str | int) -> bytes | None:
        wanted = encode_int(key) if isinstance(key, int) else key.encode() if isinstance(key, str) else key
        if len(wanted) > MAX_KEY:
            raise KeyTooLongError(f"{len(wanted)} bytes")
        page = self._leaf(wanted)
        if page is None:
            return None
        k, found = page.search(wanted)
        return self._record(page, k) if found else None

    def pages(self) -> Iterator[Page]:
        address = self.first[0][0]
        while address != NULL:
            page = self.page(address)
            yield page
            address = page.next

    def count(self) -> int:
        return sum(p.count for p in self.pages())

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        for p in self.pages():
            for k in range(p.count):
                yield p.prefix + p.entry(k)[0], self._record(p, k)

    def keys(self) -> list[bytes]:
        return [k for k, _ in self.items()]


@dataclass(frozen=True)
class StoredDocument:
    """A document of a compressed collection."""

    text: str | None
    content: str | None
    positions: bytes | None
    metadata: tuple[tuple[str, bytes], ...]

    def get_text(self) -> str:
        if self.text is None:
            raise MissingFieldError("text")
        return self.text

    def get_content(self) -> str:
        if self.content is None:
            raise MissingFieldError("content")
        return self.content


def decode_document(data: bytes) -> StoredDocument:
    """A document from its trailer of (key, value) offsets."""
    word = lambda at: struct.unpack_from("<I", data, at)[0]
    n = word(len(data) - 4)
    table = len(data) - 4 - 8 * n
    if table < 0:
        raise BadFormatError(f"{n} fields in {len(data)} bytes")
    body: bytes | None = None
    start = size = positions = None
    at = 0
    metadata = []
    for k in range(n):
        key_at, value_at = word(table + 8 * k), word(table + 8 * k + 4)
        end = word(table + 8 * k + 8) if k + 1 < n else table
        key, value = text(data[key_at : value_at - 1]), data[value_at:end]
        if key == "#TEXT#":
            body, at = value[:-1], value_at
        elif key == "#POSITIONS#":
            positions = value
        elif key == "#CONTENT#":
            start = word(value_at)
        elif key == "#CONTENTLENGTH#":
            size = word(value_at)
        else:
            metadata.append((key, value))
    if (start is None) != (size is None):
        raise BadFormatError("the start or the length of the content, without the other")
    content = text(data[at + start : at + start + size]) if body is not None and start is not None else None
    return StoredDocument(None if body is None else text(body), content, positions, tuple(metadata))


class CompressedCollection:
    """A folder with ``lookup`` (document id to offset) and ``storage`` (zlib streams)."""

    def __init__(self, folder: str | Path):
        self.offsets = Keyfile(Path(folder) / "lookup")
        self.storage = memoryview((Path(folder) / "storage").read_bytes())

    def read(self, doc_id: int) -> StoredDocument | None:
        if doc_id <= 0:
            raise BadFormatError(f"document ids begin at 1, not {doc_id}")
        found = self.offsets.lookup(doc_id)
        if found is None:
            return None
        return decode_document(zlib.decompressobj().decompress(self.storage[int.from_bytes(found[:8], "little") :]))

    def items(self) -> Iterator[tuple[int, StoredDocument]]:
        for key, value in self.offsets.items():
            yield decode_int(key), decode_document(zlib.decompressobj().decompress(self.storage[int.from_bytes(value[:8], "little") :]))
