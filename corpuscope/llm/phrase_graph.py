"""Operator 13: mine collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces and pieces into words.  Two graphs are aggregated by Spark:

- order 1: nodes are words, edges are pairs of neighbouring words;
- order 3: nodes are three words, edges are four, from their first three to their last three.

Each word occurrence is written once per graph, as the longest gram that begins
there.  Where a piece ends earlier, the shorter rest is written instead: the
piece-end correction.  The count of a shorter phrase is then the flow out of its
node, the sum of the grams that begin with it, plus its piece ends.

Order 3 leaves out what cannot reach ``min_count``: a gram is cut before the first
pair of words that is rarer, again as an end.  The pairs that may be frequent reach
the tasks as a bit map of a fixed size (``PAIR_BITS``); a wrong bit costs a row
that the final counts drop, so the results are exact with any map, and with any
amount of data.

Frequent edges form the graph that is kept.  Its unary paths, runs of nodes with
one edge in and one out, are compacted into one row per path (at most ``SEGMENT``
edges), by doubling pointers over written tables; a cycle is opened at its
least edge.  The strongest extension of a node within a path stands beside it in
the row; only nodes at the ends of paths are aggregated over paths.

Words are found and counted in the task on whole Arrow buffers, and summed by Spark;
nothing but the bit map is sent to all tasks, and no group is collected but a path segment.
Scores are exact: products are decimals of 38 digits.

Defined results: a null text is empty and adds nothing, a null language is
``und``; equal rows count each; ties of the score go to the larger count, then to
the phrase that comes first in UTF-8 byte order; other columns are ignored; an
empty table gives an empty result; texts and words of any length pass whole.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize

#: What ends a piece, what separates words, letters that are lower-cased (bytes of UTF-8).
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
SEPARATORS = b" \t"
NO_LANG = "und"
#: Size of the bit map of word pairs: 16 MB whatever the data.
PAIR_BITS = 1 << 27
#: Odd factors of a pair's slot in the map.
FIRST_FACTOR, SECOND_FACTOR = 1_000_003, 7_919
#: Bytes of text counted together in a task (one longer text is taken whole).
CHUNK_BYTES = 4 << 20
#: Rows of a batch that leaves a task.
OUT_ROWS = 1 << 16
#: Edges of a compacted path in one row.
SEGMENT = 4096

WORD, GAP, END = range(3)
GRAMS = "lang string, gram string, size int, n long"


class Words:
    """All words of some texts in order: ``ids`` into ``names``, ``langs`` into ``lang_names``, and
    ``follows``, whether the next word stands in the same piece."""

    KIND = np.zeros(256, np.uint8)
    KIND[list(SEPARATORS)] = GAP
    KIND[list(PIECE_ENDS)] = END
    LOWER = np.arange(256, dtype=np.uint8)
    LOWER[ord("A"):ord("Z") + 1] += 32

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        begins = offsets[:-1] - offsets[0]
        kind = self.KIND[data]
        word = np.concatenate([[False], kind == WORD, [False]])
        new_text = np.zeros(len(data) + 1, bool)
        new_text[begins] = True
        # a word begins after what is no word, or with a text, and stops likewise
        starts = np.flatnonzero(word[1:-1] & (~word[:-2] | new_text[:-1])).astype(np.int32)
        stops = np.flatnonzero(word[1:-1] & (~word[2:] | new_text[1:])).astype(np.int32)
        ends_at = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(stops - starts + 1, out=ends_at[1:])
        held = pa.py_buffer(self.LOWER[data[word[1:-1]]])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends_at), held]).dictionary_encode()
        self.names = words.dictionary.cast(pa.string())
        self.ids = words.indices.to_numpy().astype(np.int64)
        text_no = (np.searchsorted(begins, starts, side="right") - 1).astype(np.int32)  # of empty texts at one place the last
        coded = langs.cast(pa.string()).dictionary_encode()
        self.lang_names = coded.dictionary
        self.langs = coded.indices.to_numpy()[text_no].astype(np.int64)
        piece = np.searchsorted(np.flatnonzero(kind == END).astype(np.int32), starts).astype(np.int32)
        self.follows = np.append((piece[1:] == piece[:-1]) & (text_no[1:] == text_no[:-1]), False)[:len(starts)]

    def rows(self, langs: np.ndarray, parts: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        """Grams of the words ``parts`` with their counts as rows of ``GRAMS``."""
        words = [self.names.take(pa.array(p)) for p in parts]
        gram = pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0]
        return pa.RecordBatch.from_arrays(
            [self.lang_names.take(pa.array(langs)), gram, pa.array(np.full(len(counts), len(parts), np.int32)),
             pa.array(counts.astype(np.int64))], names=["lang", "gram", "size", "n"])


def _counted(count):
    """mapInArrow function over (lang, text): ``count(Words)`` yields the rows of some texts."""
    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            chunk = np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    for rows in count(Words(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))):
                        yield from (rows.slice(s, OUT_ROWS) for s in range(0, rows.num_rows, OUT_ROWS))
    return run


def _pairs(words: Words):
    size, ids, langs = max(1, len(words.names)), words.ids, words.langs
    i, last = np.flatnonzero(words.follows), np.flatnonzero(~words.follows)
    if len(i):
        keys, n = np.unique((langs[i] * size + ids[i]) * size + ids[i + 1], return_counts=True)
        yield words.rows(keys // size // size, [keys // size % size, keys % size], n)
    if len(last):
        keys, n = np.unique(langs[last] * size + ids[last], return_counts=True)
        yield words.rows(keys // size, [keys % size], n)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")


def _summed(grams: DataFrame) -> DataFrame:
    return grams.groupBy("lang", "gram").agg(F.max("size").alias("size"), F.sum("n").alias("n"))


def order_one(docs: DataFrame) -> DataFrame:
    """Edges (two words) and piece ends (one word) with their counts."""
    return _summed(_texts(docs).mapInArrow(_counted(_pairs), GRAMS))


def pair_map(frequent: DataFrame) -> bytes:
    """Bit map of the slots of frequent pairs: words of 64 bits are made by Spark, at most ``PAIR_BITS`` / 64 rows."""
    code = lambda c: F.crc32(F.encode(c, "UTF-8"))
    slot = (code(_first(F.col("gram"), 1)) * FIRST_FACTOR + code(_last(F.col("gram"), 1)) * SECOND_FACTOR + code(F.col("lang"))) % PAIR_BITS
    words = (frequent.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")))
    table = words.toArrow()
    out = np.zeros(PAIR_BITS // 64, "<i8")
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out.tobytes()


def order_three(docs: DataFrame, bits) -> DataFrame:
    """Edges (four words) and ends (three words: by the piece or by a rare pair) with their counts."""
    def count(words: Words):
        held, ids, langs = np.frombuffer(bits.value, np.uint8), words.ids, words.langs
        codes = np.array([crc32(w.encode()) for w in words.names.to_pylist()], np.int64)
        lang_codes = np.array([crc32(w.encode()) for w in words.lang_names.to_pylist()], np.int64)
        i = np.flatnonzero(words.follows)
        slot = (codes[ids[i]] * FIRST_FACTOR + codes[ids[i + 1]] * SECOND_FACTOR + lang_codes[langs[i]]) % PAIR_BITS
        common = np.zeros(len(ids) + 3, bool)
        common[i] = held[slot >> 3] >> (slot & 7) & 1
        # pairs are numbered, so that a gram is one key
        at = np.flatnonzero(common[:-3])
        size = max(1, len(words.names))
        pairs, numbers = np.unique((langs[at] * size + ids[at]) * size + ids[at + 1], return_inverse=True)
        pair_no = np.zeros(len(ids) + 3, np.int64)
        pair_no[at] = numbers
        first = lambda keys: pairs[keys] // size % size
        second = lambda keys: pairs[keys] % size
        three = np.flatnonzero(common[:-3] & common[1:-2])
        four = common[three + 2]
        edges, ends = three[four], three[~four]
        if len(edges):
            keys, n = np.unique(pair_no[edges] * len(pairs) + pair_no[edges + 2], return_counts=True)
            left, right = keys // len(pairs), keys % len(pairs)
            yield words.rows(pairs[left] // size // size, [first(left), second(left), first(right), second(right)], n)
        if len(ends):
            keys, n = np.unique(pair_no[ends] * size + ids[ends + 2], return_counts=True)
            left = keys // size
            yield words.rows(pairs[left] // size // size, [first(left), second(left), keys % size], n)

    return _summed(_texts(docs).mapInArrow(_counted(count), GRAMS))


def _first(c, n):
    return F.substring_index(c, " ", n)


def _last(c, n):
    return F.substring_index(c, " ", -n)


def node_flow(grams: DataFrame, words: int, min_count: int = 1) -> DataFrame:
    """Counts of all phrases of ``words`` words: flow out of the node plus piece ends."""
    return (grams.where(F.col("size") >= words).groupBy("lang", _first(F.col("gram"), words).alias("gram"))
            .agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def compact_paths(edges: DataFrame) -> DataFrame:
    """Unary paths of the graph of ``edges`` (lang, gram of four words, n).

    One row per path segment: lang, head (first edge of the path), segment (from 0),
    nodes (arrays of the three-word nodes, one more than edges) and weights.
    """
    e = materialize(edges.select("lang", "gram", "n", _first(F.col("gram"), 3).alias("src"), _last(F.col("gram"), 3).alias("dst")),
                    "phrase-edges")
    out_one = e.groupBy("lang", "src").agg(F.count(F.lit(1)).alias("k"), F.min("gram").alias("follower")).where("k = 1")
    in_one = e.groupBy("lang", "dst").agg(F.count(F.lit(1)).alias("k"), F.min("gram").alias("leader")).where("k = 1")
    # one edge in and one out: the node joins its two edges
    links = out_one.withColumnRenamed("src", "node").drop("k").join(
        in_one.withColumnRenamed("dst", "node").drop("k"), ["lang", "node"])
    links = links.select("lang", F.col("follower").alias("gram"), F.col("leader").alias("back"))
    # place: edges passed on the way back to `back`; least: the least edge seen on it, which opens a cycle
    chain = materialize(e.join(links, ["lang", "gram"], "left").select(
        "lang", "gram", F.coalesce("back", "gram").alias("back"), F.when(F.col("back").isNotNull(), 1).otherwise(0).cast("long").alias("place"),
        F.least("gram", F.coalesce("back", "gram")).alias("least"), F.col("back").isNotNull().alias("open")), "phrase-chain")

    def doubled(c: DataFrame) -> DataFrame:
        behind = c.select("lang", F.col("gram").alias("back"), F.col("back").alias("far"), F.col("place").alias("more"),
                          F.col("least").alias("far_least"), F.col("open").alias("far_open"))
        moved = c.where("open").join(behind, ["lang", "back"]).select(
            "lang", "gram", F.col("far").alias("back"), (F.col("place") + F.col("more")).alias("place"),
            F.least("least", "far_least").alias("least"), F.col("far_open").alias("open"),
            (F.col("far_least") < F.col("least")).alias("moved"))
        return materialize(c.where("not open").withColumn("moved", F.lit(False)).unionByName(moved, allowMissingColumns=True),
                           "phrase-chain")

    def run(c: DataFrame) -> DataFrame:
        """Double until no end is open, or those left lie on cycles: each round closes edges of every
        path that still has open ones, and a least edge that moves nowhere is that of the whole cycle."""
        open_before = None
        while True:
            state = c.agg(F.count_if("open").alias("open"), F.count_if(F.col("open") & F.col("moved")).alias("moved")).first()
            if state["open"] == 0 or (state["open"] == open_before and not state["moved"]):
                return c
            open_before = state["open"]
            c = doubled(c.drop("moved"))

    chain = run(chain.withColumn("moved", F.lit(True)))
    cycles = chain.where("open")
    if cycles.limit(1).count():
        start = F.col("gram") == F.col("least")
        opened = cycles.select("lang", "gram", "least").join(links, ["lang", "gram"]).select(
            "lang", "gram", F.when(start, F.col("gram")).otherwise(F.col("back")).alias("back"),
            F.when(start, 0).otherwise(1).cast("long").alias("place"), "least", (~start).alias("open"), F.lit(True).alias("moved"))
        chain = chain.where("not open").unionByName(run(materialize(opened, "phrase-cycles")))
    placed = chain.select("lang", "gram", F.col("back").alias("head"), "place").join(e, ["lang", "gram"])
    return placed.groupBy("lang", "head", F.expr(f"place div {SEGMENT}").alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("place", "src", "dst", "n"))).alias("run")).select(
        "lang", "head", "segment",
        F.concat(F.transform("run", lambda r: r["src"]), F.array(F.element_at("run", -1)["dst"])).alias("nodes"),
        F.transform("run", lambda r: r["n"]).alias("weights"))


def path_extensions(paths: DataFrame) -> DataFrame:
    """The strongest edge at each node.  Inner nodes of a path have both their edges in the row;
    the two ends of a path may belong to other paths too and are aggregated."""
    at = F.posexplode("nodes").alias("i", "gram")
    rows = paths.select("lang", "weights", F.size("weights").alias("k"), at).select(
        "lang", "gram", (F.col("i") > 0).alias("inner_left"), (F.col("i") < F.col("k")).alias("inner_right"),
        F.greatest(F.when(F.col("i") > 0, F.element_at("weights", F.greatest(F.col("i"), F.lit(1)))),
                   F.when(F.col("i") < F.col("k"), F.element_at("weights", F.least(F.col("i") + 1, F.col("k"))))).alias("longer"))
    inner = rows.where("inner_left and inner_right").select("lang", "gram", "longer")
    ends = rows.where("not (inner_left and inner_right)").groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    return inner.unionByName(ends)


def collocations(docs: DataFrame, min_count: int = 30, cover: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two to four words of each language by their weakest cut.

    Columns: lang, rank (int), phrase, a (count), l and r (counts of the two sides of the
    cut), n (words of the language), score = floor(2000000 a / (l + r)).  Candidates occur
    ``min_count`` times or more; one whose words stand in a longer candidate with at least
    ``cover`` per cent of its count is left out.  Writes tables below the shared folder and
    runs jobs at once.
    """
    spark = docs.sparkSession
    one = materialize(order_one(docs), "phrase-pairs")
    pairs = materialize(one.where((F.col("size") == 2) & (F.col("n") >= min_count)).select("lang", "gram", "n"), "phrase-frequent-pairs")
    totals = one.groupBy("lang").agg(F.sum("n").alias("n"))  # every occurrence begins one gram
    words = node_flow(one, 1, min_count)
    three = materialize(order_three(docs, spark.sparkContext.broadcast(pair_map(pairs))).where(F.col("n") > 0), "phrase-grams")
    triples = node_flow(three, 3, min_count)
    edges = three.where((F.col("size") == 4) & (F.col("n") >= min_count)).select("lang", "gram", "n")
    counts = materialize(words.withColumn("size", F.lit(1)).unionByName(pairs.withColumn("size", F.lit(2)))
                         .unionByName(triples.withColumn("size", F.lit(3))).unionByName(edges.withColumn("size", F.lit(4))),
                         "phrase-counts")
    paths = materialize(compact_paths(edges), "phrase-paths")

    grown = counts.where("size = 3")
    around = grown.select("lang", "n", F.explode(F.array(_first(F.col("gram"), 2), _last(F.col("gram"), 2))).alias("gram"))
    longer = around.groupBy("lang", "gram").agg(F.max("n").alias("longer")).unionByName(path_extensions(paths))
    candidates = counts.where("size > 1").join(longer, ["lang", "gram"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("n").cast("decimal(38,0)") * cover))

    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "size", cut)
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("left"),
                       F.expr("substring_index(phrase, ' ', k - size)").alias("right"))
    side = lambda name, n: counts.select("lang", F.col("gram").alias(name), F.col("n").alias(n))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).withColumn(
        "score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals,
                       "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
