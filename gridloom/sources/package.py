"""ZIP packages in any store that pyarrow opens, written from parts that are compressed already."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs

# Fixed values of the ZIP and deflate formats.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_UTF8_NAMES, _DEFLATED, _STORED, _JAN_1980, _BIG = 0x800, 8, 0, 0x21, 0xFFFFFFFF
#: A last, empty block.
LAST_BLOCK = b"\x03\x00"
_CRC_POLYNOMIAL = 0xEDB88320


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path)


def files_at(path: str, suffix: str) -> list[str]:
    """Files with the suffix at a path: itself, or all below a folder; as URIs or paths, like ``path``."""
    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    below = store.get_file_info(fs.FileSelector(place, recursive=True))
    head = path[: len(path) - len(place)] if path.endswith(place) else path.rstrip("/")[: len(path.rstrip("/")) - len(place.rstrip("/"))]
    return sorted(head + x.path for x in below if x.is_file and x.path.lower().endswith(suffix))


def _product(a: int, b: int) -> int:
    """Product of polynomials over two elements modulo that of the checksum; bit 31 is the constant."""
    out = 0
    for i in range(32):
        if a >> (31 - i) & 1:
            out ^= b
        b = b >> 1 ^ (_CRC_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The checksum of two runs of bytes from each one's, the second being ``size`` bytes long."""
    power, square, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            power = _product(power, square)
        square = _product(square, square)
        n >>= 1
    return _product(power, first) ^ second


@dataclass(frozen=True)
class Piece:
    """A part of an entry: deflated bytes without a last block, held here or in a file."""

    crc: int
    size: int
    packed: int
    data: bytes = b""
    path: str = ""


def piece(data: bytes) -> Piece:
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    out = pack.compress(data) + pack.flush(zlib.Z_FULL_FLUSH)
    return Piece(zlib.crc32(data), len(data), len(out), out)


class PackageWriter:
    """Writes a ZIP archive front to back. Entries of 4 GB and more, and archives of any size, are
    written in the format's long form."""

    def __init__(self, stream):
        self.stream, self.at, self.entries = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _begin(self, name: str, method: int, crc: int, size: int, packed: int) -> None:
        long = size >= _BIG or packed >= _BIG
        extra = struct.pack("<HHQQ", 1, 16, size, packed) if long else b""
        raw = name.encode()
        self.entries.append((raw, method, crc, size, packed, self.at))
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45 if long else 20, _UTF8_NAMES, method, 0, _JAN_1980, crc, _BIG if long else packed, _BIG if long else size, len(raw), len(extra)) + raw + extra)

    def entry(self, name: str, pieces: list[Piece], read) -> None:
        """An entry from deflated pieces; ``read`` yields the bytes of one that is in a file."""
        crc = size = packed = 0
        for p in pieces:
            crc, size, packed = joined_crc(crc, p.crc, p.size), size + p.size, packed + p.packed
        self._begin(name, _DEFLATED, crc, size, packed + len(LAST_BLOCK))
        for p in pieces:
            for data in read(p.path) if p.path else (p.data,):
                self._put(data)
        self._put(LAST_BLOCK)

    def copied(self, name: str, method: int, crc: int, size: int, packed: int, data: Iterator[bytes]) -> None:
        """An entry whose compressed bytes are taken over as they are."""
        self._begin(name, method, crc, size, packed)
        for part in data:
            self._put(part)

    def close(self) -> None:
        start = self.at
        for raw, method, crc, size, packed, at in self.entries:
            long = max(size, packed, at) >= _BIG
            extra = struct.pack("<HHQQQ", 1, 24, size, packed, at) if long else b""
            shown = [_BIG] * 3 if long else [packed, size, at]
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if long else 20, _UTF8_NAMES, method, 0, _JAN_1980, crc, shown[0], shown[1], len(raw), len(extra), 0, 0, 0, 0, shown[2]) + raw + extra)
        count, size = len(self.entries), self.at - start
        if count >= 0xFFFF or max(size, start) >= _BIG:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<IIQI", _LOCATOR64, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, _BIG), min(start, _BIG), 0))
