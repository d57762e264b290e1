"""Secret scan: fixed patterns and character Markov models (native).

Two first-order Markov chains over the characters of tokens are trained in
Spark from labelled samples: random strings and ordinary identifiers.  A token
of at least ``TOKEN_LENGTH`` characters is a secret when its mean log-likelihood
ratio per transition reaches the threshold, which lies between the two samples'
scores, or when the mean of any ``TOKEN_LENGTH`` transitions in a row reaches the
threshold for windows: a random string behind a name or path is found however
long the ordinary part is.  The span is the whole token.  The transition table has a fixed size (alphabet squared), so it is
collected and becomes one array literal in the scan, which is a plain map over
the texts: no shuffle.

Positions come from SQL functions alone: ``regexp_extract_all`` gives the
leftmost non-overlapping matches, ``split`` by the same pattern the text between
them, and their lengths add up to the starts (code points).

Defined results: null text counts as empty and gives no spans; spans of
different kinds may overlap; repeated rows give repeated results.  Extra columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import whole_text

#: Fixed values, in the order of the kinds: pattern, group whose length counts, its least length.  A greedy run
#: with a least length needs no second test, so its pattern states the length itself.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]
#: An assignment holds one of these words, in any letter case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Characters of tokens; the first stands for the start of a token.
ALPHABET = "^ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_LENGTH = 20
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_LENGTH
#: Labelled samples generated per class.
SAMPLES = 4000

#: Parts that ordinary identifiers and words of the samples are made of.
PARTS = ("get set make user name file path list item count index value table column row data load read write open close "
         "start stop first last next order price total number string array object class method test check update remove "
         "create delete parse format token result error message request response server client page view model state "
         "der die und nicht werden haben les des pour dans avec que una para como esta entre sobre the and that with "
         "international administration understanding configuration environment communication responsibility").split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``token, random``: ``n`` random strings (hexadecimal, base64, mixed) and ``n`` identifiers, made by rule."""
    i = F.col("id")
    digest = F.sha2(i.cast("string"), 256)
    random = spark.range(n).select(
        F.when(i % 3 == 0, F.substring(digest, 1, 40))
        .when(i % 3 == 1, F.substring(F.base64(F.unhex(digest)), 1, 40))
        .otherwise(F.regexp_replace(F.substring(F.base64(F.unhex(digest)), 3, 32), "[+/=]", "7")).alias("token"),
        F.lit(True).alias("random"))
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    word = lambda salt: F.get(parts, F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(PARTS))).cast("int"))
    four = [word(s) for s in range(4)]
    plain = spark.range(n).select(
        F.when(i % 4 == 0, F.concat_ws("_", *four)).when(i % 4 == 1, F.concat(four[0], *[F.initcap(w) for w in four[1:]]))
        .when(i % 4 == 2, F.concat_ws("-", *four)).otherwise(F.concat(*four)).alias("token"),
        F.lit(False).alias("random"))
    return random.unionByName(plain)


def embedded_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``token, random``: ``n`` random strings of ``TOKEN_LENGTH`` behind a name or path, and ``n`` long paths, made by rule."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("embedded:"), i.cast("string")), 256)
    string = F.when(i % 3 == 0, F.substring(digest, 1, TOKEN_LENGTH)).otherwise(
        F.substring(F.base64(F.unhex(digest)), 1, TOKEN_LENGTH))
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    words = lambda count: F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.get(
        parts, F.pmod(F.xxhash64(F.lit("embedded"), i, k), F.lit(len(PARTS))).cast("int")))
    random = spark.range(n).select(
        F.when(i % 2 == 0, F.concat(F.array_join(words(3), "_"), F.lit("="), string))
        .otherwise(F.concat(F.array_join(words(5), "/"), F.lit("/"), string)).alias("token"), F.lit(True).alias("random"))
    plain = spark.range(n).select(F.array_join(words(16), "/").alias("token"), F.lit(False).alias("random"))
    return random.unionByName(plain)


#: Matches in one block of running sums.
BLOCK = 512


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios of all transitions (row-major over ALPHABET) and the thresholds of the means."""

    ratios: tuple[float, ...]
    threshold: float
    window_threshold: float = float("inf")

    def scores(self, token: Column) -> Column:
        """``mean`` of the log-likelihood ratios per transition, random against ordinary, and ``window``, the highest
        mean of ``TOKEN_LENGTH`` transitions in a row (null for shorter tokens); linear in the characters."""
        table = F.split(F.lit(",".join(f"{x:.4f}" for x in self.ratios)), ",").cast("array<double>")
        size = len(ALPHABET)
        codes = F.transform(F.split(F.concat(F.lit(ALPHABET[0]), token), ""), lambda c: F.instr(F.lit(ALPHABET), c))

        def scan(code):
            ratio = lambda i: F.element_at(table, (F.get(code, i - 1) - 1) * size + F.get(code, i))

            def step(state, i):
                r = ratio(i)
                gone = F.when(i > TOKEN_LENGTH, ratio(i - TOKEN_LENGTH)).otherwise(0.0)
                held = state["held"] + r - gone
                best = F.when(i >= TOKEN_LENGTH, F.greatest(state["best"], held)).otherwise(state["best"])
                return F.struct((state["sum"] + r).alias("sum"), held.alias("held"), best.alias("best"))

            start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("held"), F.lit(None).cast("double").alias("best"))
            steps = F.filter(F.sequence(F.lit(0), F.size(code) - 1), lambda i: i > 0)
            return F.aggregate(steps, start, step, lambda s: F.struct(
                (s["sum"] / (F.size(code) - 1)).alias("mean"), (s["best"] / TOKEN_LENGTH).alias("window")))

        # one array element, so that the codes are made once and not for every step
        return F.get(F.transform(F.array(codes), scan), 0)

    def score(self, token: Column) -> Column:
        """Mean log-likelihood ratio per transition, random against ordinary."""
        return self.scores(token)["mean"]

    def is_random(self, token: Column) -> Column:
        """Whether the whole token or a window of it reaches its threshold."""
        either = lambda s: (s["mean"] >= self.threshold) | F.coalesce(s["window"] >= self.window_threshold, F.lit(False))
        return F.exists(F.array(self.scores(token)), either)


def train(samples: DataFrame, smoothing: float = 0.5) -> MarkovModel:
    """Fit both chains to ``samples(token, random)``; only the transition table reaches the driver."""
    spark, size = samples.sparkSession, len(ALPHABET)
    marked = F.concat(F.lit(ALPHABET[0]), F.col("token"))
    pairs = samples.select("random", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("token")), lambda i: F.substr(marked, i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    chars = F.split(F.lit(ALPHABET), "")
    table = (spark.range(1).select(F.posexplode(chars).alias("i", "a")).select("i", "a", F.posexplode(chars).alias("j", "b"))
             .withColumn("pair", F.concat("a", "b")).join(F.broadcast(counts), "pair", "left"))
    row = Window.partitionBy("i")
    logp = lambda c: F.log((F.coalesce(F.col(c), F.lit(0)) + smoothing)
                           / (F.coalesce(F.sum(c).over(row), F.lit(0)) + smoothing * size))
    ratios = tuple(x.ratio for x in table.select("i", "j", (logp("r") - logp("o")).alias("ratio")).orderBy("i", "j").collect())
    model = MarkovModel(ratios, 0.0)
    edge = samples.withColumn("score", model.score(F.col("token"))).agg(
        F.percentile(F.when(F.col("random"), F.col("score")), 0.01).alias("low"),
        F.percentile(F.when(~F.col("random"), F.col("score")), 0.99).alias("high")).first()
    embedded = embedded_samples(spark).withColumn("score", model.scores(F.col("token"))["window"]).agg(
        F.percentile(F.when(F.col("random"), F.col("score")), 0.01).alias("low"),
        F.percentile(F.when(~F.col("random"), F.col("score")), 0.99).alias("high")).first()
    return MarkovModel(ratios, round((edge.low + edge.high) / 2, 4), round((embedded.low + embedded.high) / 2, 4))


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _sums_before(sizes: Column) -> Column:
    """For each of ``sizes`` the sum of those before it.

    Sums are listed within blocks of ``BLOCK``, and over the sums of the blocks, so that lists that grow
    element by element stay short: the work follows the number of sizes.
    """
    def running(values, first):
        step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["list"], F.array(s["at"])).alias("list"))
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("list"))
        return F.aggregate(values, start, step, lambda s: s["list"])

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / BLOCK).cast("int") - 1),
                         lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))

    def joined(held):
        sums = F.transform(held, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, v: s + v))
        return F.flatten(F.zip_with(held, running(sums, F.lit(0).cast("bigint")), running))

    return _once(blocks, joined)


def _span_list(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """``array<struct<start, kind_order, end, kind>>`` of the leftmost non-overlapping matches."""
    values = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in sorted({0, group})]
    zipped = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("before"), values[0].alias("found"), values[-1].alias("value")),
                      lambda x: x["found"].isNotNull())

    def spans(matches):
        sizes = F.transform(matches, lambda x: (F.length(x["before"]) + F.length(x["found"])).cast("bigint"))
        placed = _once(sizes, lambda s: F.zip_with(matches, _sums_before(s), lambda x, at: F.struct(
            (at + F.length(x["before"])).cast("int").alias("start"), F.lit(order).alias("kind_order"),
            (at + F.length(x["before"]) + F.length(x["found"])).cast("int").alias("end"), F.lit(kind).alias("kind"),
            F.length(x["value"]).alias("size"))))
        long = F.filter(placed, lambda x: x["size"] >= least)
        return F.transform(long, lambda x: F.struct(x["start"].alias("start"), x["kind_order"].alias("kind_order"),
                                                    x["end"].alias("end"), x["kind"].alias("kind")))

    return _once(zipped, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(_no_spans()))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")


def _markov_spans(text: Column, model: MarkovModel) -> Column:
    """Spans of long tokens that the model calls random."""
    order = len(BASE)
    tokens = _span_list(text, order, "markov", TOKEN, 0, TOKEN_LENGTH)
    values = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    judged = F.filter(F.arrays_zip(tokens.alias("span"), values.alias("token")),
                      lambda x: model.is_random(x["token"]))
    return F.transform(judged, lambda x: x["span"])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, model: MarkovModel, text_col: str = "text") -> Column:
    """Sorted spans of a text; kinds after the base ones come from the model."""
    text = whole_text(text_col)
    lower = F.lower(text)
    assign_word = F.lit(False)
    for word in ASSIGN_WORDS:
        assign_word |= F.contains(lower, F.lit(word))
    may = {"assign": assign_word, "access": F.contains(text, F.lit("AKIA")), "hex": F.rlike(text, F.lit("[0-9a-f]{24}"))}
    lists = [F.when(may[kind], _span_list(text, i, kind, *rule)).otherwise(_no_spans())
             for i, (kind, *rule) in enumerate(BASE)]
    lists.append(F.when(F.rlike(text, F.lit(TOKEN)), _markov_spans(text, model)).otherwise(_no_spans()))
    return F.array_sort(F.concat(*lists))


def secret_scan(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found``.

    ``spans`` lists all spans as ``kind:start:end`` (code points, end exclusive)
    by start and kind, ``found`` holds them as structs; ``base_sha256`` digests
    the list of the base kinds alone.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), secret_spans(docs, model, text_col).alias("found"))
    base = F.filter("found", lambda s: s["kind_order"] < len(BASE))
    of_kind = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.col("found")).alias("spans"), "found")
