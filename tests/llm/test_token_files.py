import io
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuscope.llm import pfor, token_ids
from corpuscope.llm.queries_files import tokenizer_path
from corpuscope.llm.token_files import read_token_files, write_token_files

SCHEMA = "doc_id long, text string, body string, START int"
ODD = ["İstanbul ΣΑΣ  ας.", "don't we'll 'S 'T x'S", "á é, ́b", "<|endoftext|> x<|startoftext|>y", "日本 12 3.5%", "", "\x85 \xa0a b",
       "K kelvin ſ", "ABC.,! Ab:; ?x!", "a" * 5000, "ẞ ß ﬁ Å", "\x00 a\x00b", "it's IT'S. 's.", "</w> a</w>", "\t\x0b\x0c\r\n", "é. É! éé;"]


def direct(texts):
    t = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kept", [40, token_ids.KEPT_WORDS])
def test_words_encode_like_whole_texts(monkeypatch, kept):
    monkeypatch.setattr(token_ids, "KEPT_WORDS", kept)
    monkeypatch.setattr(token_ids, "CHUNK_BYTES", 2000)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist() + ODD
    words = token_ids.WordEncoder(tokenizer_path())
    for _ in range(2):
        got = [np.frombuffer(x, words.dtype).tolist() for x in words.encode(t.encode() for t in texts)]
        assert got == direct(texts)


WORDS = None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    global WORDS
    WORDS = WORDS or token_ids.WordEncoder(tokenizer_path())
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert [np.frombuffer(x, WORDS.dtype).tolist() for x in WORDS.encode(t.encode() for t in texts)] == direct(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-2**63, 2**63 - 1)), st.integers(0, 3000),
                          st.sampled_from([1, 2, 100, 49408, 2**32])), max_size=8), st.integers(0, 2**32))
def test_file_round_trip(docs, seed):
    rnd = np.random.default_rng(seed)
    rows = [(name, rnd.integers(0, top, n).astype("<u4")) for name, n, top in docs]
    out = io.BytesIO()
    assert pfor.write_file(out, rows) == sum(len(i) for _, i in rows)
    reader = pfor.TokenFile(pa.BufferReader(out.getvalue()))
    got = list(reader.documents(run=500))
    at = 0
    for (name, ids), (g_name, start, g_ids) in zip(rows, got, strict=True):
        assert name == g_name and start == at and g_ids.tolist() == ids.tolist()
        at += len(ids)
    assert reader.ids(at // 3, at).tolist() == np.concatenate([i for _, i in rows] + [np.empty(0, "<u4")])[at // 3:].tolist()


def test_outliers_are_exceptions():
    ids = np.full(4096, 7, "<u4")
    ids[::100] = 2**31
    blocks = pfor.encode_blocks(ids)
    assert sum(map(len, blocks)) < 600
    offsets = np.cumsum([0, *map(len, blocks)])
    assert np.concatenate(list(pfor.decode_blocks(b"".join(blocks), offsets))).tolist() == ids.tolist()


def test_query_on_odd_rows_and_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows = [(i * 7 - 9, t, "x", 1) for i, t in enumerate(ODD)] + [(d + 1000, t, None, None) for d, t in docs[:300]]
    rows += [(None, "null id", "", 0), (None, None, "", 0), (5000, None, "", 0), (5000, "same id", "", 0), (5000, "same id", "", 0),
             (5001, "long " * 200_000, "", 0)]
    got = read_token_files(write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(5), tokenizer_path(), 2)).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = sorted(((r[0], len(i) + 1, crc(i + [2])) for r, i in zip(rows, direct([r[1] or "" for r in rows]))), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want


def test_empty_table(spark):
    assert read_token_files(write_token_files(spark.createDataFrame([], SCHEMA), tokenizer_path(), 2)).collect() == []


def test_long_words_are_not_kept():
    import base64
    import random

    from corpuscope.llm.queries_files import tokenizer_path
    from corpuscope.llm.token_ids import KEPT_BYTES, WordEncoder

    rnd = random.Random(6)
    word = lambda: base64.b64encode(rnd.randbytes(15_000)).rstrip(b"=").decode()
    texts = [f"Start {word()} middle, {word()}." for _ in range(100)] + ["plain words stay."]
    coder = WordEncoder(tokenizer_path())
    got = list(coder.encode([t.encode() for t in texts]))
    assert [np.frombuffer(g, coder.dtype).tolist() for g in got] == [
        e.ids for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert coder.young and all(len(w) <= KEPT_BYTES for w in [*coder.young, *coder.old])


def test_learning_words_makes_no_container_a_word():
    """Tuples, one per new word, woke the collector again and again."""
    import gc
    import random
    import string

    words = token_ids.WordEncoder(tokenizer_path())
    rng = random.Random(3)
    text = " ".join("".join(rng.choices(string.ascii_letters, k=7)) + rng.choice(["", "."]) for _ in range(30000)).encode()
    gc.collect()
    before = gc.get_stats()[0]["collections"]
    list(words.encode([text]))
    assert gc.get_stats()[0]["collections"] - before <= 2


def test_words_in_small_letters_are_kept_once():
    from corpuscope.llm.queries_files import tokenizer_path
    from corpuscope.llm.token_ids import WordEncoder

    class Counted(dict):
        sets = 0

        def __setitem__(self, key, value):
            Counted.sets += 1
            super().__setitem__(key, value)

    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(600)]
    text = " ".join([*words, "Éa éb", "c1", "Upper", "end."])
    encoder = WordEncoder(tokenizer_path())
    encoder.young = Counted()
    packed, = encoder.encode([text.encode()])
    assert np.frombuffer(packed, encoder.dtype).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert Counted.sets < len(words)


def test_known_words_are_not_walked_for_every_chunk():
    walked = []

    class Word(bytes):
        def __hash__(self):
            walked.append(self)
            return bytes.__hash__(self)

    words = token_ids.WordEncoder(tokenizer_path())
    words.young = {Word(b"w%d" % i): b"" for i in range(1000)}
    walked.clear()
    assert [np.frombuffer(x, words.dtype).tolist() for x in words.encode([b"The cat, the Cat."])] == direct(["The cat, the Cat."])
    assert not walked
