"""Reading and writing the variable-length integers of on-disk indexes."""

from __future__ import annotations

import struct

from ..errors import BadFormatError


class Cursor:
    """A position in a buffer."""

    def __init__(self, data: bytes | memoryview, at: int = 0, end: int | None = None):
        self.data = memoryview(data)
        self.at = at
        self.end = len(self.data) if end is None else end

    def eof(self) -> bool:
        return self.at >= self.end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise BadFormatError(f"wanted {n} bytes at {self.at} of {self.end}")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def number(self, layout: str) -> int:
        return struct.unpack(layout, self.take(struct.calcsize(layout)))[0]

    def vbyte(self) -> int:
        """Low groups first; the high bit marks the last byte."""
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b & 0x80:
                return value
            shift += 7

    def signed_vbyte(self) -> int:
        """The lowest bit is the sign."""
        raw = self.vbyte()
        return -(raw >> 1) if raw & 1 else raw >> 1

    def big_vbyte(self) -> int:
        """High groups first; the high bit marks that more follow."""
        value = 0
        while True:
            b = self.take(1)[0]
            value = value << 7 | b & 0x7F
            if not b & 0x80:
                return value


def vbyte(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F)
        value >>= 7
    out.append(value | 0x80)
    return bytes(out)


def signed_vbyte(value: int) -> bytes:
    return vbyte(abs(value) << 1 | (value < 0))


def big_vbyte(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        raise BadFormatError(f"not UTF-8: {e}") from e
