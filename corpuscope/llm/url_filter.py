"""URL filter: glob rules as one bit-parallel Shift-And automaton.

Every glob is laid out as bits of a multiword mask; one pass over a canonical
URL (host, lower-cased, and path) moves the states of all globs at once, for all
URLs of a batch together.  ``*`` in the host part stays within the host, after
the first ``/`` it matches anything.  A domain rule ``host/path`` becomes two
globs, ``host/path*`` and ``*.host/path*``.

Defined results: a null URL or one without ``://`` has empty host and path and
fits no rule with a path; it gets the default verdict unless a glob matches the
empty string.  Of the domain rules that fit the longest wins, then the first in
the list; without one, a blocking glob decides, then the default.  Repeated rows
are judged one by one; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: URLs stepped through together.
BATCH = 4096


@dataclass(frozen=True)
class Rule:
    """A domain rule: the host itself and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}*", f"*.{self.host}{self.path}*"]


class ShiftAnd:
    """Simultaneous matcher of glob patterns over byte strings.

    Bit ``offset + j`` of a state says that the first ``j`` literal bytes of a
    pattern have been read.  ``step[c]`` has the bits reached by reading ``c``,
    ``stay[c]`` those that a star at this place keeps while reading ``c``.
    """

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        sizes = [len(p.encode().replace(b"*", b"")) + 1 for p in patterns]
        self.words = max(1, (sum(sizes) + 63) // 64)
        step, stay = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        start, final = np.zeros(self.words * 64, bool), []
        at = 0
        for pattern in patterns:
            start[at] = True
            in_host = True
            for c in pattern.encode():
                if c == ord("*"):
                    stay[:, at] = True
                    if in_host:
                        stay[ord("/"), at] = False
                else:
                    in_host = in_host and c != ord("/")
                    at += 1
                    step[c, at] = True
            final.append(at)
            at += 1
        self.step, self.stay, self.start = _packed(step), _packed(stay), _packed(start)
        self.final = np.array(final, np.int64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Which patterns (columns) match each whole text (rows)."""
        out = np.zeros((len(texts), len(self.patterns)), bool)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for i in range(0, len(order), BATCH):
            rows = order[i:i + BATCH]
            out[rows] = self._run([texts[r] for r in rows])
        return out

    def _run(self, texts: list[bytes]) -> np.ndarray:
        """``texts`` by falling length: those that have ended leave from the back."""
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        codes = np.frombuffer(b"".join(texts), np.uint8)
        state = np.repeat(self.start[None], len(texts), 0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(texts)
        for j in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths[:live], -j, "left"))  # those longer than j
            c, now = codes[starts[:live] + j], state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            after = (moved & self.step[c]) | (now & self.stay[c])
            state[:live] = after
        word, bit = self.final // 64, (self.final % 64).astype(np.uint64)
        return ((state[:, word] >> bit) & one).astype(bool)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Boolean bits to little-endian 64-bit words along the last axis."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8").astype(np.uint64)


def url_host(url: str | Column = "url") -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: str | Column = "url") -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_verdicts(pages: DataFrame, rules: list[Rule], block_globs: list[str], default: str = "allow",
                 id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: its id, ``host, path, rule, verdict, block_glob`` (the first blocking glob that matches)."""
    patterns = [g for r in rules for g in r.globs()] + list(block_globs)
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    src = pages.select(F.col(id_col), url_host(url_col).alias("host"), url_path(url_col).alias("path"))
    schema = StructType(list(src.schema.fields)).add("rule", "string").add("verdict", "string").add("block_glob", "string")

    def run(batches):
        automaton = ShiftAnd(patterns)
        for batch in batches:
            texts = [(h + p).encode() for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            hit = automaton.match(texts)
            rule = np.full(len(texts), -1)
            for i in reversed(ranked):  # the longest is set last
                rule[hit[:, 2 * i] | hit[:, 2 * i + 1]] = i
            globs = hit[:, 2 * len(rules):]
            first = np.where(globs.any(axis=1), globs.argmax(axis=1), -1) if block_globs else np.full(len(texts), -1)
            verdict = [rules[r].verdict if r >= 0 else "block" if g >= 0 else default for r, g in zip(rule, first)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([rules[r].name if r >= 0 else None for r in rule], pa.string()),
                 pa.array(verdict, pa.string()), pa.array([block_globs[g] if g >= 0 else None for g in first], pa.string())],
                schema.names)

    return src.mapInArrow(run, schema)
