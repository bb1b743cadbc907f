"""Base-call, filter and tile records as numpy arrays; no Spark here.

All integers are little-endian. A base-call byte holds the base in bits 0-1 and the quality in bits 2-7.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Base and quality characters of every base-call byte.
_BYTES = np.arange(256, dtype=np.uint8)
BASE_OF = np.where(_BYTES >> 2 == 0, ord("N"), np.frombuffer(b"ACGT", np.uint8)[_BYTES & 3]).astype(np.uint8)
QUALITY_OF = ((_BYTES >> 2) + 33).astype(np.uint8)


class FormatError(ValueError):
    """A file that doesn't hold what its format asks for."""


@dataclass(frozen=True)
class Header:
    version: int
    size: int
    base_bits: int
    quality_bits: int
    bins: tuple[tuple[int, int], ...]
    num_tiles: int
    tiles_at: int


@dataclass(frozen=True)
class Tile:
    tile: int
    clusters: int
    unpacked_size: int
    packed_size: int
    offset: int


def read_header(data: bytes, path: str = "") -> Header:
    """The fixed part of a per-cycle file of many tiles: bins, then the number of tiles."""
    if len(data) < 12:
        raise FormatError(f"{path}: header of {len(data)} bytes")
    version, size, base_bits, quality_bits, n = struct.unpack_from("<HIBBI", data)
    at = 12 + 8 * n
    if len(data) < at + 4:
        raise FormatError(f"{path}: header ends within its quality bins")
    bins = tuple(struct.unpack_from("<II", data, 12 + 8 * i) for i in range(n))
    return Header(version, size, base_bits, quality_bits, bins, struct.unpack_from("<I", data, at)[0], at + 4)


def read_tiles(data: bytes, header: Header, path: str = "") -> list[Tile]:
    """Tile records; blocks follow the header in their order, without gaps."""
    end = header.tiles_at + 16 * header.num_tiles
    if len(data) < end:
        raise FormatError(f"{path}: tile list ends early")
    records = np.frombuffer(data, "<u4", 4 * header.num_tiles, header.tiles_at).reshape(-1, 4).astype(np.int64)
    offsets = header.size + np.concatenate([[0], np.cumsum(records[:, 3])[:-1]]) if len(records) else []
    return [Tile(*map(int, r), int(o)) for r, o in zip(records, offsets)]


def quality_values(header: Header, quality_map: str = "linear") -> np.ndarray:
    """The quality of each 2-bit bin: 2, 12, 22, 32 ("linear"), or what the header's bins say."""
    if quality_map == "linear":
        return np.arange(4, dtype=np.uint8) * 10 + 2
    if quality_map != "header":
        raise ValueError("quality_map is 'linear' or 'header'")
    table = dict(header.bins)
    return np.array([table.get(i, 0) for i in range(4)], np.uint8)


def unpack_block(packed: bytes, clusters: int, values: np.ndarray, path: str = "") -> np.ndarray:
    """Base-call bytes of a tile's block: two clusters to a byte, the even one in the low half."""
    try:
        data = zlib.decompress(packed, 31)
    except zlib.error as e:
        raise FormatError(f"{path}: block can't be inflated: {e}") from e
    if len(data) < (clusters + 1) // 2:
        raise FormatError(f"{path}: block of {len(data)} bytes for {clusters} clusters")
    return call_bytes(data, clusters, values)


def call_bytes(data: bytes, clusters: int, values: np.ndarray) -> np.ndarray:
    """Base-call bytes of inflated halves."""
    pairs = np.frombuffer(data, np.uint8)
    halves = np.empty(2 * len(pairs), np.uint8)
    halves[0::2], halves[1::2] = pairs & 15, pairs >> 4
    halves = halves[:clusters]
    return (values[halves >> 2] << 2) | (halves & 3)


class Inflating:
    """The inflated bytes of a gzipped block of a file, from its beginning on; of all its members or of the first. The file isn't held open."""

    CHUNK = 1 << 16

    def __init__(self, path: str, at: int = 0, size: int = -1, members: bool = False, name: str = ""):
        self.path, self.at, self.left, self.members, self.name = path, at, size, members, name or path
        self.packed, self.inflater = b"", zlib.decompressobj(31)

    def _more(self) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(self.at)
            data = f.read(self.CHUNK if self.left < 0 else min(self.CHUNK, self.left))
        self.at += len(data)
        self.left -= len(data) if self.left >= 0 else 0
        return data

    def _some(self, most: int) -> bytes:
        """Some bytes, `most` or fewer; none at the end."""
        while True:
            if self.inflater.eof:
                rest = self.inflater.unused_data.lstrip(b"\0") if self.members else b""
                while self.members and not rest and (data := self._more()):
                    rest = data.lstrip(b"\0")
                if not rest:
                    return b""
                self.packed, self.inflater = rest, zlib.decompressobj(31)
            packed = self.packed or self._more()
            try:
                data = self.inflater.decompress(packed, most)
            except zlib.error as e:
                raise FormatError(f"{self.name}: block can't be inflated: {e}") from e
            self.packed = self.inflater.unconsumed_tail
            if data:
                return data
            if not packed and not self.inflater.eof:
                raise FormatError(f"{self.name}: block can't be inflated: it ends early")

    def read(self, n: int) -> bytes:
        """The next n bytes; fewer only at the end."""
        parts = []
        while n and (data := self._some(n)):
            parts.append(data)
            n -= len(data)
        return b"".join(parts)

    def skip(self, n: int | None = None) -> int:
        """How many of the next n bytes there were; without n, of all that are left, whose checksum is then checked."""
        seen = 0
        while (n is None or seen < n) and (data := self._some(self.CHUNK if n is None else min(self.CHUNK, n - seen))):
            seen += len(data)
        return seen


def read_count(path: str) -> int:
    """The cluster count of a gzipped file of one cycle, from its beginning alone."""
    try:
        with gzip.open(path, "rb") as f:
            head = f.read(4)
    except (OSError, EOFError, zlib.error) as e:
        raise FormatError(f"{path}: can't be inflated: {e}") from e
    if len(head) < 4:
        raise FormatError(f"{path}: no cluster count")
    return struct.unpack("<I", head)[0]


def read_filter(data: bytes, path: str = "") -> np.ndarray:
    """Whether each cluster passes: its byte is 1."""
    if len(data) < 8:
        raise FormatError(f"{path}: filter of {len(data)} bytes")
    at = 4
    if struct.unpack_from("<I", data)[0] == 0:
        at = 8
    if len(data) < at + 4:
        raise FormatError(f"{path}: filter without a count")
    n = struct.unpack_from("<I", data, at)[0]
    if len(data) < at + 4 + n:
        raise FormatError(f"{path}: {len(data) - at - 4} of {n} clusters")
    return np.frombuffer(data, np.uint8, n, at + 4) == 1
