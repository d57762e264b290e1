"""Patched frame-of-reference blocks of token ids, and files of them.

A block of up to ``BLOCK`` ids holds their minimum and the differences to it,
packed at the width that fits the ``PERCENTILE`` of them; larger differences
(exceptions) stand apart with their places.

    block   u32 minimum, u8 width, u8 0, u16 ids, u16 exceptions, then
            packed differences (64 values to ``width`` 64-bit words; the last
            group is filled up with zeros), u16 places, u32 differences
    file    magic, blocks, footer, u64 footer length, magic
    footer  u64 blocks, u64 documents, u64 offset of every block and of the
            footer, i64 document ids, u8 marks of null ids, u64 first id of every
            document in the file and after the last

All numbers are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1024
PERCENTILE = 0.98
MAGIC = b"PFORIDS1"
_HEAD = "<IBBHH"
_HEAD_SIZE = struct.calcsize(_HEAD)
#: Blocks encoded or decoded together.
_CHUNK = 512


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(groups, 64) values of ``width`` bits to (groups, width) words."""
    lanes, out = np.ascontiguousarray(values.T.astype(np.uint64)), np.zeros((width, len(values)), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """(groups, width) words back to (groups, 64) values."""
    rows, out = np.ascontiguousarray(words.T), np.zeros((64, words.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[j] = rows[word] >> np.uint64(shift)
        if shift + width > 64:
            out[j] |= rows[word + 1] << np.uint64(64 - shift)
        out[j] &= mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """All ids in blocks; only the last one may be shorter."""
    out: list[bytes] = []
    full = len(ids) // BLOCK * BLOCK
    for at in range(0, full, BLOCK * _CHUNK):
        out += _encode(ids[at:min(full, at + BLOCK * _CHUNK)].reshape(-1, BLOCK), BLOCK)
    if full < len(ids):
        n = len(ids) - full
        tail = np.full(-(-n // 64) * 64, ids[full:].min(), ids.dtype)
        tail[:n] = ids[full:]
        out += _encode(tail[None], n)
    return out


def _encode(rows: np.ndarray, n: int) -> list[bytes]:
    rows = rows.astype(np.int64)
    least = rows.min(axis=1)
    diff = rows - least[:, None]
    k = min(diff.shape[1] - 1, int(PERCENTILE * n))
    width = _bits(np.partition(diff, k, axis=1)[:, k])
    over = diff >> width[:, None] > 0
    kept = np.where(over, 0, diff)
    packed: list[bytes] = [b""] * len(rows)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        words = _pack(kept[at].reshape(-1, 64), w).reshape(len(at), -1)
        for i, row in zip(at.tolist(), words):
            packed[i] = row.tobytes()
    out = []
    for i in range(len(rows)):
        places = np.flatnonzero(over[i])
        out.append(struct.pack(_HEAD, int(least[i]), int(width[i]), 0, n, len(places)) + packed[i]
                   + places.astype("<u2").tobytes() + diff[i, places].astype("<u4").tobytes())
    return out


def decode_blocks(buf: bytes, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Ids (uint32) of the blocks that start at ``offsets`` (the last is the end), in runs of blocks."""
    for at in range(0, len(offsets) - 1, _CHUNK):
        starts = offsets[at:min(at + _CHUNK, len(offsets) - 1)].tolist()
        heads = [struct.unpack_from(_HEAD, buf, s) for s in starts]
        parts: list[np.ndarray | None] = [None] * len(heads)
        by_width: dict[tuple[int, int], list[int]] = {}
        for i, (_, width, _, n, _) in enumerate(heads):
            by_width.setdefault((width, -(-n // 64)), []).append(i)
        for (width, groups), members in by_width.items():
            words = np.frombuffer(b"".join(buf[starts[i] + _HEAD_SIZE:starts[i] + _HEAD_SIZE + 8 * width * groups]
                                           for i in members), "<u8").reshape(len(members) * groups, width)
            values = _unpack(words, width).reshape(len(members), -1)
            for row, i in zip(values, members):
                least, _, _, n, exceptions = heads[i]
                if exceptions:
                    p = starts[i] + _HEAD_SIZE + 8 * width * groups
                    places = np.frombuffer(buf, "<u2", exceptions, p)
                    row[places] = np.frombuffer(buf, "<u4", exceptions, p + 2 * exceptions)
                parts[i] = (row[:n] + np.uint64(least)).astype("<u4")
        yield np.concatenate(parts)


def write_file(out, docs: Iterable[tuple[int | None, np.ndarray]]) -> int:
    """Write documents (id, ids) to a stream, a few blocks at a time; returns the number of ids."""
    out.write(MAGIC)
    at, offsets, names, starts = len(MAGIC), [], [], [0]
    held, size = [], 0

    def flush(ids):
        nonlocal at
        for block in encode_blocks(ids):
            offsets.append(at)
            out.write(block)
            at += len(block)

    for name, ids in docs:
        names.append(name)
        starts.append(starts[-1] + len(ids))
        held.append(ids)
        size += len(ids)
        if size >= BLOCK * _CHUNK:
            ids = np.concatenate(held)
            full = len(ids) // BLOCK * BLOCK
            flush(ids[:full])
            held, size = [ids[full:]], len(ids) - full
    if size:
        flush(np.concatenate(held))
    footer = b"".join((struct.pack("<QQ", len(offsets), len(names)), np.array([*offsets, at], "<u8").tobytes(),
                       np.array([x or 0 for x in names], "<i8").tobytes(), bytes(x is None for x in names),
                       np.array(starts, "<u8").tobytes()))
    out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
    return starts[-1]


class TokenFile:
    """Reader of one file: the document index, and the ids of any range by the block index."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(size - 16)
        end = stream.read(16)
        if end[8:] != MAGIC:
            raise ValueError("not a file of token id blocks")
        length = struct.unpack("<Q", end[:8])[0]
        stream.seek(size - 16 - length)
        footer = stream.read(length)
        blocks, docs = struct.unpack_from("<QQ", footer)
        p = 16
        self.offsets = np.frombuffer(footer, "<u8", blocks + 1, p).astype(np.int64)
        p += 8 * (blocks + 1)
        names, nulls = np.frombuffer(footer, "<i8", docs, p), footer[p + 8 * docs:p + 9 * docs]
        self.names = [None if null else int(x) for x, null in zip(names, nulls)]
        self.starts = np.frombuffer(footer, "<u8", docs + 1, p + 9 * docs).astype(np.int64)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` of the file: only the blocks that hold them are read."""
        if first >= end:
            return np.empty(0, "<u4")
        a, b = first // BLOCK, -(-end // BLOCK)
        self.stream.seek(int(self.offsets[a]))
        buf = self.stream.read(int(self.offsets[b] - self.offsets[a]))
        found = np.concatenate(list(decode_blocks(buf, self.offsets[a:b + 1] - self.offsets[a])))
        return found[first - a * BLOCK:end - a * BLOCK]

    def documents(self, run: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start in the file, ids) of every document, read in runs of about ``run`` ids."""
        at = 0
        while at < len(self.names):
            end = int(np.searchsorted(self.starts, self.starts[at] + run, "right")) - 1
            end = min(max(end, at + 1), len(self.names))
            ids = self.ids(int(self.starts[at]), int(self.starts[end]))
            for i in range(at, end):
                a, b = (int(self.starts[j] - self.starts[at]) for j in (i, i + 1))
                yield self.names[i], int(self.starts[i]), ids[a:b]
            at = end
