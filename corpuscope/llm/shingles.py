"""Word shingles of whole texts as sets of 64-bit hashes (NumPy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Words in a shingle.
WORDS = 5
#: Bytes of normalised text hashed at once; longer texts go in overlapping pieces.
PIECE_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A random odd value for each byte, so that texts of different length never collide by zeros.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT)) | np.uint64(1)


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            step = np.full(size, _MULT, np.uint64)
            back = np.full(size, pow(_MULT, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            cls.up, cls.down = np.cumprod(step), np.cumprod(back)
        return cls.up[:n], cls.down[:n]


def _span_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``buf[start:end]``, from prefix sums of a polynomial, place-independent."""
    codes = np.frombuffer(buf, np.uint8)
    up, down = _Powers.get(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * up[:-1], out=prefix[1:])
    return _mix((prefix[ends] - prefix[starts]) * down[starts])


def _pieces(words: list[bytes], k: int) -> Iterator[bytes]:
    """Normalised pieces of a long text that overlap by ``k - 1`` words, so no shingle is lost."""
    at = 0
    while True:
        size, end = 0, at
        while end < len(words) and (size < PIECE_BYTES or end - at < k):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[at:end])
        if end >= len(words):
            return
        at = end - (k - 1)


def shingle_sets(texts: Iterable[bytes | None], k: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space.
    A text of fewer than ``k`` words has one shingle, its whole word sequence;
    an empty one has none.
    """
    held: list[bytes] = []  # pieces of the current chunk
    owner: list[int] = []   # how many pieces belong to each text of the chunk
    size = 0
    for text in texts:
        words = (text or b"").lower().split()
        norm = b" ".join(words)
        parts = [norm] if len(norm) <= 2 * PIECE_BYTES else list(_pieces(words, k))
        held += parts
        owner.append(len(parts))
        size += len(norm)
        if size >= PIECE_BYTES:
            yield from _chunk(held, owner, k)
            held, owner, size = [], [], 0
    if owner:
        yield from _chunk(held, owner, k)


def _chunk(parts: list[bytes], owner: list[int], k: int) -> Iterator[np.ndarray]:
    buf = b"\n".join(parts)  # normalised texts hold no line break of their own
    codes = np.frombuffer(buf, np.uint8)
    cuts = np.flatnonzero((codes == 32) | (codes == 10))
    starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(codes)]))
    last = np.concatenate((np.flatnonzero(codes[cuts] == 10), [len(starts) - 1]))  # last word of each part
    first = np.concatenate(([0], last[:-1] + 1))
    hashes = _span_hashes(buf, starts[:max(0, len(starts) - k + 1)], ends[k - 1:]) if len(starts) >= k else None
    at = 0
    for n in owner:
        found = []
        for p in range(at, at + n):
            i, j = int(first[p]), int(last[p])
            if j - i + 1 >= k:
                found.append(hashes[i:j - k + 2])
            elif len(parts[p]):
                found.append(_span_hashes(parts[p], np.array([0]), np.array([len(parts[p])])))
        at += n
        yield np.unique(found[0] if len(found) == 1 else np.concatenate(found)) if found else np.empty(0, np.uint64)
