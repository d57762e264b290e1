"""Token ids of whole texts inside Spark tasks, with the ids of known words kept per worker."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

#: Words whose ids a worker keeps in each of two generations; the older one is dropped when the newer is full.
KEPT_WORDS = 500_000
#: Longest word, in bytes, that is kept beyond the texts it is met in.
KEPT_BYTES = 64
#: Bytes of text encoded together.
CHUNK_BYTES = 2 << 20


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file.

    The package travels with each task by value, so its own globals start anew in
    every task; what a worker keeps from task to task lives in a module entry.
    """
    import sys
    import types

    kept = sys.modules.setdefault("corpuscope_worker_state", types.ModuleType("corpuscope_worker_state")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


class WordEncoder:
    """Encodes texts word by word; ids are kept as packed little-endian bytes.

    The tokenizer drops white space and no token reaches across it, so a text's
    ids are those of its words, cut at ASCII white space, one after the other.
    Tests hold this against encoding whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # each word is asked for once: the model's own memory of words costs more than it finds
        getattr(self.tokenizer.model, "_resize_cache", lambda words: None)(0)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.ends = np.zeros(size, bool)  # the token closes a run of letters
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.long: list[bytes] = []  # words of the present texts that are not kept

    def _encode(self, letters: list[bytes], rest: list[bytes]) -> None:
        """Make the ids of words known: of ``letters`` (a-z only) and ``rest``, all different.

        Runs of letters go through the tokenizer as one text, cut after their
        closing tokens; other words one by one.
        """
        # flat lists: tuples would wake the collector, once per few hundred words
        plain, others = letters, []
        for w in rest:
            (plain if w.decode("utf-8", "replace").isalpha() else others).append(w)
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(plain).decode("utf-8")], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(plain):
            packed, cuts = ids.astype(self.dtype).tobytes(), (cuts * self.dtype.itemsize).tolist()
            self.young.update(zip(plain, map(packed.__getitem__, map(slice, [0, *cuts], cuts))))
        else:
            others += plain
        if others:
            done = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in others], add_special_tokens=False)
            for w, e in zip(others, done):
                self.young[w] = np.array(e.ids, self.dtype).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        """Make ``words`` known: from the older generation, or as a run of letters and closing punctuation."""
        known, old = self.young, self.old
        new = words.difference(old)
        if len(new) < len(words):
            known.update({w: old[w] for w in words.difference(new)})
        letters, rest, built, lows, tails = set(), set(), [], [], []
        for w in new:
            if w.isalpha():  # A-Z and a-z only
                low = w.lower()
                if low == w:  # nothing to build it from
                    letters.add(w)
                    continue
                part, tail = letters, b""
            else:
                core = w.rstrip(b".,!?;:")
                tail = w[len(core):]
                if core.isalpha():
                    low, part = core.lower(), letters
                elif core and tail and core.decode("utf-8", "replace").isalpha():
                    low, part = core, rest
                else:
                    rest.add(w)
                    continue
                if tail not in known:
                    rest.add(tail)
            if low not in known:
                part.add(low)
            built.append(w)
            lows.append(low)
            tails.append(tail)
        for part in (letters, rest):
            again = {w for w in part if w in old}
            known.update({w: old[w] for w in again})
            part -= again
        if letters or rest:
            self._encode(list(letters), list(rest))
        for w, low, tail in zip(built, lows, tails):
            known[w] = known[low] + known[tail] if tail else known[low]

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """Packed ids (``dtype``) of each UTF-8 text; null is empty."""
        held, size = [], 0
        for t in texts:
            held.append((t or b"").split())  # bytes split at ASCII white space alone
            size += len(t or b"")
            if size >= CHUNK_BYTES:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def _chunk(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        words = set().union(*texts)
        missing = words.difference(self.young)  # of the keys' view all keys would be walked
        if len(self.young) + len(missing) > KEPT_WORDS:
            self.old, self.young = self.young, {}
            missing = words
        if missing:
            held = len(self.young)
            self._learn(missing)
            if len(self.young) > held:
                self.long = [w for w in islice(reversed(self.young), len(self.young) - held) if len(w) > KEPT_BYTES]
        known = self.young
        for t in texts:
            yield b"".join(map(known.__getitem__, t))
        for w in self.long:
            del known[w]
        self.long = []
