"""Quality rules: text statistics and a learned decision list.

The statistics of a whole text are computed in Arrow batches.  The decision
list is learned by sequential covering on a bounded sample of labelled
documents: a rule (a conjunction of at most ``MAX_CONDITIONS`` thresholds) is
grown on two thirds of the sample by information gain, pruned on the other
third, accepted when it is precise enough on the whole sample, and the documents
it covers are taken out before the next one.  The list becomes one ordered Spark
conditional expression over the statistics.

Defined results: null text counts as empty, has zero statistics and fails the
base rule.  Labels that are null or contradict each other are not used.  Without
labels of both classes the list is empty and keeps everything.  Ties between
conditions go to the first in (statistic, direction, threshold) order.  Extra
columns pass through unread; repeated rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpuscope.llm.common import fresh, materialize, whole_text

#: Labelled documents used for learning, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: A rule rejects only with this precision on the sample, and covers at least this share of the rejected class.
PRECISION, LEAST_SHARE = 0.97, 0.02
MAX_CONDITIONS, MAX_RULES, CUTS = 3, 12, 64

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words"]

_CLASS = np.full(256, 2, np.uint8)          # 2: a character of a word
_CLASS[0x80:0xC0] = 0                       # 0: continuation of a UTF-8 character
_CLASS[[32, 9, 10, 11, 12, 13]] = 1         # 1: white space
_CLASS[list(b"#*$%&|<>")] = 3               # 3: symbols, characters of words too


def _repeated(words: list[bytes], numbers: dict[bytes, int]) -> int:
    """Words inside a window of three words that the text has twice or more."""
    if len(words) < 4:
        return 0
    ids = np.fromiter((numbers[w] for w in words), np.int64, len(words))
    size = len(numbers)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # the number of a window would pass 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    if len(count) == len(windows):
        return 0
    twice = count[place] > 1
    mark = np.zeros(len(words), bool)
    for j in range(3):
        mark[j:len(words) - 2 + j] |= twice
    return int(np.count_nonzero(mark))


def stats_of(text: bytes | None) -> tuple[int, ...]:
    """The values of STATS for one whole text."""
    text = text or b""
    words = text.split()  # bytes split at exactly the white space of the contract
    numbers: dict[bytes, int] = {}
    for w in words:
        numbers.setdefault(w, len(numbers))
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=4)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), int(kinds[2] + kinds[3]), int(kinds[3]), len(lines) - len(set(lines)),
            _repeated(words, numbers), len(lines), len(numbers))


@F.pandas_udf(StructType([StructField(s, LongType()) for s in STATS]))
def _stats_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stats_of(t) for t in texts], columns=STATS, dtype="int64")


def text_stats(text: str | Column = "text") -> Column:
    """Struct of STATS."""
    return _stats_udf(whole_text(text).cast("binary"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """What conditions are about: sizes and shares."""
    share = lambda a, b: s[a] / F.greatest(s[b], F.lit(1))
    return {"n_words": s["n_words"].cast("double"), "word_length": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct_words", "n_words"),
            "line_words": share("n_words", "n_lines")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def expression(self, x: dict[str, Column]) -> Column:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects, a text that none covers is kept."""

    rules: tuple[Rule, ...] = ()

    def keeps(self, stats: Column) -> Column:
        x, out = features(stats), None
        for rule in self.rules:
            cond = F.lit(True)
            for c in rule:
                cond &= c.expression(x)
            out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x, bad, rows) -> Rule:
    """Add the condition with the largest information gain until only bad rows are covered."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        p, n = np.count_nonzero(bad[rows]), np.count_nonzero(~bad[rows])
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (0.0, None)
        for name, values in x.items():
            v, b = values[rows], bad[rows]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cuts = np.unique(np.linspace(0, len(v) - 2, CUTS).astype(int)) if len(v) > 1 else []
            good_to, bad_to = np.cumsum(~b), np.cumsum(b)
            for i in cuts:
                i = int(np.searchsorted(v, v[i], "right")) - 1  # equal values stay together
                if i + 1 >= len(v):
                    continue
                cut = float((v[i] + v[i + 1]) / 2)
                for above in (False, True):
                    p1, n1 = (p - bad_to[i], n - good_to[i]) if above else (bad_to[i], good_to[i])
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, above, cut))
        if best[1] is None:
            break
        rule += (best[1],)
        rows = rows & best[1].holds(x)
    return rule


def _prune(rule: Rule, x, bad, rows) -> Rule:
    """Drop last conditions while that does not lower (bad - good) / covered on the pruning rows."""
    def worth(r):
        hit = _covered(r, x, len(bad)) & rows
        p, n = np.count_nonzero(bad & hit), np.count_nonzero(~bad & hit)
        return (p - n) / (p + n) if p + n else -1.0
    best = rule
    for size in range(len(rule) - 1, 0, -1):
        if worth(rule[:size]) >= worth(best):
            best = rule[:size]
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION,
          least_share: float = LEAST_SHARE) -> DecisionList:
    """Sequential covering on feature arrays and the mask of rows to reject (rows in random order)."""
    n = len(bad)
    if not bad.any() or bad.all():
        return DecisionList()
    left, grow = np.ones(n, bool), np.arange(n) % 3 != 2
    least, rules = max(3, least_share * np.count_nonzero(bad)), []
    while len(rules) < MAX_RULES and (bad & left).any():
        rule = _prune(_grow(x, bad, left & grow), x, bad, left & ~grow)
        hit = _covered(rule, x, n) & left
        wrong, right = np.count_nonzero(~bad & hit), np.count_nonzero(bad & hit)
        if not rule or right < least or right < precision * (right + wrong):
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(tuple(rules))


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn which documents have label 0, from at most ``sample_rows`` labelled ones.

    The labelled ids of the sample are broadcast (their number is the bound),
    and as many rows of seven numbers reach the driver.
    """
    one = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
           .agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).filter("label = other"))
    sample = materialize(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "label"), "quality-sample")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = (texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", text_stats().alias("s"))
             .groupBy("doc_id", "label").agg(F.min("s").alias("s")))
    rows = (found.select("doc_id", "label", *[v.alias(k) for k, v in features(F.col("s")).items()],
                         base_failed(F.col("s")).alias("base_failed"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").toPandas())
    rows = rows[~rows["base_failed"]]  # the base rule takes these already
    return learn({k: rows[k].to_numpy() for k in features(F.col("s"))}, rows["label"].to_numpy() == 0)


def quality_verdicts(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, STATS, ``base_failed, kept``."""
    s = F.col("s")
    return (docs.select(F.col(id_col).alias("doc_id"), text_stats(text_col).alias("s"))
            .select("doc_id", "s.*", base_failed(s).alias("base_failed"),
                    (~base_failed(s) & rules.keeps(s)).alias("kept")))


def drop_rejected(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The documents that pass the base rule and the decision list, all columns unchanged."""
    (name,) = fresh(docs, "quality_stats")
    s = F.col(name)
    return docs.withColumn(name, text_stats(text_col)).filter(~base_failed(s) & rules.keeps(s)).drop(name)
