"""Mixing sources to target weights by iterative proportional fitting (native).

Documents are counted into cells (source, language, topic) by their words.  Target
shares are the natural shares raised to a power (1 keeps them, 0 makes all equal);
given target tables replace them.  What a target asks of a source, language or topic
may exceed the words there are: such a value is taken whole and the others share the
rest of the budget in proportion to their targets (``attainable``).

Cells are then raked with bounds: in every round the words to take of a cell are
scaled to the attainable amount of its source, then of its language, then of its
topic, and never exceed the words of the cell, so full cells leave and the rest is
raked again until marginals and budget settle.  A cell's sampling probability is the
words to take over its words.  A document is taken when a hash of its id falls below
its cell's probability, so the sample does not depend on partitions or order.
``marginal_shares`` sets what was asked against what is attainable and achieved.

Defined results: null source or language is a category of its own; null text
counts as empty and has no words; a cell without words has probability zero.  Rows that
repeat an id are taken or left together.  An empty table gives no rows.  Extra
columns pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import fresh, materialize, whole_text

ROUNDS = 16
#: Powers of the natural shares that are the targets of the three marginals.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Share of all words to sample.
BUDGET = 0.7
SEED = "mix-1"
NONE = "(none)"
#: Up to so many cells are raked as one sorted partition; more are shuffled by marginal.
ONE_PARTITION_CELLS = 100_000


def words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: str | Column = "text") -> Column:
    """Topic by rule: licences and code credentials, tables, symbol noise, questions and prose."""
    t = whole_text(text)
    size = F.greatest(F.length(t), F.lit(1))
    return (F.when(F.contains(t, F.lit("icense")), "legal")
            .when(50 * F.regexp_count(t, F.lit("[|]")) > size, "table")
            .when(50 * F.regexp_count(t, F.lit("[#$%&*<>]")) > size, "noise")
            .when(F.contains(t, F.lit("?")), "question").otherwise("prose"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(NONE))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cells(docs: DataFrame, source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``source, lang, topic, n_docs, w0`` (words) of every cell."""
    return (docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)).alias("source"),
                        F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("lang"),
                        topic(text_col).alias("topic"), words(text_col).alias("n"))
            .groupBy("source", "lang", "topic").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("w0")))


def with_targets(counted: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET) -> DataFrame:
    """Cells with the target share of each marginal value (``t_source``, ``t_lang``, ``t_topic``) and the words
    that can be taken of it (``a_source``, ...).

    In the order of words per target share, a value is taken whole while its words do not reach what the
    budget left would give it; ``level`` is what a unit of target share gets then.
    """
    whole = Window.partitionBy()
    for name, power in powers.items():
        shares = counted.groupBy(name).agg(F.sum("w0").cast("double").alias("have"))
        shares = shares.withColumn("p", F.pow("have", F.lit(power)))
        shares = shares.select(F.col(name).alias("key"), "have", F.coalesce(F.col("p") / F.nullif(F.sum("p").over(whole), F.lit(0.0)), F.lit(0.0)).alias(f"t_{name}"))
        order = Window.orderBy((F.col("have") / F.nullif(F.col(f"t_{name}"), F.lit(0.0))).asc_nulls_first(), "key")
        before = F.coalesce(F.sum("have").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum(f"t_{name}").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        shares = shares.withColumn("level", (F.sum("have").over(whole) * budget - before) / F.nullif(rest, F.lit(0.0)))
        shares = shares.withColumn("level", F.max(F.when(F.col("have") > F.col("level") * F.col(f"t_{name}"), F.col("level"))).over(whole))
        shares = shares.select("key", f"t_{name}", F.coalesce(F.least("have", F.col("level") * F.col(f"t_{name}")), F.col("have")).alias(f"a_{name}"))
        counted = counted.join(shares, F.col(name) == F.col("key")).drop("key")
    return counted


def rake(targeted: DataFrame, rounds: int = ROUNDS, budget: float = BUDGET, names=tuple(POWERS)) -> DataFrame:
    """``w``: the words to take of each cell, scaled to what can be taken of every marginal value in turn,
    ``rounds`` times, and at most the words of the cell; ``p``, their share of the cell's words."""
    raked = targeted.withColumn("w", F.col("w0") * F.lit(float(budget)))
    for _ in range(rounds):
        for name in names:
            sum_w = F.sum("w").over(Window.partitionBy(name))
            raked = raked.withColumn("w", F.when(sum_w > 0, F.least(F.col("w0").cast("double"), F.col("w") * F.col(f"a_{name}") / sum_w))
                                     .otherwise(0.0))
    return raked.withColumn("p", F.when(F.col("w0") > 0, F.col("w") / F.col("w0")).otherwise(0.0))


def marginal_shares(fitted: DataFrame, names=tuple(POWERS)) -> DataFrame:
    """``marginal, value, target, attainable, achieved``: shares of the words asked for, shares there are words
    for, and expected shares of the sample."""
    out = None
    for name in names:
        whole = Window.partitionBy()
        g = fitted.groupBy(F.lit(name).alias("marginal"), F.col(name).alias("value")).agg(
            F.first(f"t_{name}").alias("target"), F.first(f"a_{name}").alias("a"), F.sum("w").alias("w"))
        g = g.select("marginal", "value", "target", (F.col("a") / F.nullif(F.sum("a").over(whole), F.lit(0.0))).alias("attainable"),
                     (F.col("w") / F.nullif(F.sum("w").over(whole), F.lit(0.0))).alias("achieved"))
        out = g if out is None else out.unionByName(g)
    return out


def fit(docs: DataFrame, budget: float = BUDGET, powers: dict[str, float] = POWERS, rounds: int = ROUNDS,
        source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Stored cells with ``w`` (words to take) and ``p`` (sampling probability).

    The number of cells depends on the categories, not on the rows.  Up to
    ``ONE_PARTITION_CELLS`` of them are raked as one partition, which saves a
    shuffle per marginal and round; the same expressions run shuffled beyond that.
    """
    counted = materialize(cells(docs, source_col, lang_col, text_col), "mix-cells")
    targeted = materialize(with_targets(counted, powers, budget), "mix-targets")
    if targeted.count() <= ONE_PARTITION_CELLS:
        targeted = targeted.coalesce(1)
    return materialize(rake(targeted, rounds, budget, tuple(powers)), "mix-fitted")


def _placed(docs: DataFrame, fitted: DataFrame, id_col: str, source_col: str, lang_col: str, text_col: str,
            names: list[str]) -> DataFrame:
    """``docs`` with cell columns, p and u under ``names``."""
    s, g, t, p, u = names
    rows = (docs.withColumn(s, F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)))
            .withColumn(g, F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE))).withColumn(t, topic(text_col)))
    small = fitted.select(F.col("source").alias(s), F.col("lang").alias(g), F.col("topic").alias(t), F.col("p").alias(p))
    if fitted.count() <= ONE_PARTITION_CELLS:
        small = F.broadcast(small)
    return rows.join(small, [s, g, t]).withColumn(u, uniform(F.col(id_col)))


def mix(docs: DataFrame, fitted: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang",
        text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, source, lang, topic, p, u, sampled``."""
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("s"), F.col(lang_col).alias("g"), F.col(text_col).alias("text"))
    return (_placed(one, fitted, "doc_id", "s", "g", "text", ["source", "lang", "topic", "p", "u"])
            .select("doc_id", "source", "lang", "topic", "p", "u", (F.col("u") < F.col("p")).alias("sampled")))


def sample(docs: DataFrame, fitted: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang",
           text_col: str = "text") -> DataFrame:
    """The documents that are taken, all columns unchanged."""
    names = fresh(docs, "mix_source", "mix_lang", "mix_topic", "mix_p", "mix_u")
    rows = _placed(docs, fitted, id_col, source_col, lang_col, text_col, names)
    return rows.filter(F.col(names[4]) < F.col(names[3])).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sql(budget: float = BUDGET, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same in ANSI SQL, over a view ``documents``."""
    steps = [f"""d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t
           FROM documents)""",
             r"""n AS (SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n,
           CASE WHEN contains(t, 'icense') THEN 'legal'
                WHEN 50 * len(regexp_extract_all(t, '[|]')) > greatest(length(t), 1) THEN 'table'
                WHEN 50 * len(regexp_extract_all(t, '[#$%&*<>]')) > greatest(length(t), 1) THEN 'noise'
                WHEN contains(t, '?') THEN 'question' ELSE 'prose' END AS topic FROM d)""",
             "c AS (SELECT source, lang, topic, sum(n)::DOUBLE AS w0 FROM n GROUP BY ALL)"]
    last = "c"
    for name, power in powers.items():
        steps.append(f"""h_{name} AS (SELECT {name}, sum(w0) AS have, pow(sum(w0), {power}) AS q FROM c GROUP BY {name})""")
        steps.append(f"""s_{name} AS (SELECT {name}, have, coalesce(q / nullif(sum(q) OVER (), 0), 0) AS t FROM h_{name})""")
        order = f"OVER (ORDER BY have / nullif(t, 0) NULLS FIRST, {name} ROWS BETWEEN"
        steps.append(f"""l_{name} AS (SELECT *, (sum(have) OVER () * {budget} - coalesce(sum(have) {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / nullif(sum(t) {order} CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lv FROM s_{name})""")
        steps.append(f"""m_{name} AS (SELECT {name}, have, t, max(CASE WHEN have > lv * t THEN lv END) OVER () AS lv FROM l_{name})""")
        steps.append(f"""c_{name} AS (SELECT x.*, coalesce(least(have, lv * t), have) AS a_{name}
           FROM {last} x JOIN m_{name} USING ({name}))""")
        last = f"c_{name}"
    steps.append(f"r0 AS (SELECT *, w0 * {float(budget)!r} AS w FROM {last})")
    i = 0
    for _ in range(rounds):
        for name in powers:
            s = f"sum(w) OVER (PARTITION BY {name})"
            steps.append(f"r{i + 1} AS (SELECT * REPLACE (CASE WHEN {s} > 0 THEN least(w0, w * a_{name} / {s}) ELSE 0 END AS w) FROM r{i})")
            i += 1
    steps.append(f"f AS (SELECT source, lang, topic, CASE WHEN w0 > 0 THEN w / w0 ELSE 0 END AS p FROM r{i})")
    uniform_sql = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '{NONE}')), 1, 13))::BIGINT / {float(1 << 52)!r}"
    return ("WITH " + ",\n".join(steps) + f"""
SELECT doc_id, n.source, n.lang, n.topic, p, {uniform_sql} AS u, {uniform_sql} < p AS sampled
FROM n JOIN f ON n.source = f.source AND n.lang = f.lang AND n.topic = f.topic""")
