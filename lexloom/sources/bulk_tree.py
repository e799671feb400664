"""Bulk trees: B-trees of 8 KiB blocks, written in one go, the root last."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from ..errors import BadFormatError
from .streams import Cursor

BLOCK = 8192
_LEAF = 0x8000


def is_maybe_bulk_tree(path: str | Path) -> bool:
    """There is no magic number: any file of whole blocks may be one."""
    p = Path(path)
    return p.is_file() and p.stat().st_size >= BLOCK and p.stat().st_size % BLOCK == 0


class BulkTree:
    def __init__(self, path: str | Path):
        self.data = memoryview(Path(path).read_bytes())
        if len(self.data) < BLOCK or len(self.data) % BLOCK:
            raise BadFormatError(f"{path}: {len(self.data)} bytes aren't whole blocks")

    def block(self, k: int) -> tuple[bool, list[tuple[bytes, bytes]]]:
        """Whether a block is a leaf, and its entries."""
        if not 0 <= k < len(self.data) // BLOCK:
            raise BadFormatError(f"no block {k}")
        data = self.data[k * BLOCK : (k + 1) * BLOCK]
        word = struct.unpack_from("<H", data)[0]
        at, out = 2, []
        for i in range(word & ~_LEAF):
            key_end, value_end = struct.unpack_from("<HH", data, BLOCK - 4 * (i + 1))
            out.append((bytes(data[at:key_end]), bytes(data[key_end:value_end])))
            at = value_end
        return bool(word & _LEAF), out

    def find(self, key: bytes | str) -> bytes | None:
        wanted = key.encode() if isinstance(key, str) else key
        k = len(self.data) // BLOCK - 1
        while True:
            leaf, entries = self.block(k)
            if leaf:
                return next((v for have, v in entries if have == wanted), None)
            below = [v for have, v in entries if have <= wanted] or [v for _, v in entries[:1]]
            if not below:
                return None
            k = int.from_bytes(below[-1], "little")

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        """All entries of the leaves, in order."""
        for k in range(len(self.data) // BLOCK):
            leaf, entries = self.block(k)
            if leaf:
                yield from entries


@dataclass(frozen=True)
class TermData:
    """Statistics of a term: in the corpus, and in each field (collection and document frequency)."""

    collection_frequency: int
    document_frequency: int
    max_length: int
    min_length: int
    fields: tuple[tuple[int, int], ...]


def read_term_data(value: bytes, n_fields: int) -> TermData:
    at = Cursor(value)
    return TermData(at.vbyte(), at.vbyte(), at.vbyte(), at.vbyte(), tuple((at.vbyte(), at.vbyte()) for _ in range(n_fields)))
