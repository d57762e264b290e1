"""Wide intent CSV input (SRC-1, SRC-2) and saved projects (SRC-6).

Encodings: UTF-8, cp1252, Latin-1, UTF-16.  ``detect_encodings`` decides per
file from the raw lines of its splits, with SQL functions: a
UTF-16 byte-order mark first (the reference's auto list can never reach UTF-16,
trap T-2), then the first of UTF-8 / cp1252 / Latin-1 that decodes.  Files that
share encoding and header are read together, split by split (``csv_split``).
Encodings and headers are looked up at once.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.sources.corpus import wide_to_corpus
from corpuscope.sources.csv_split import lines, read_records, split_states

# fixed values: names and order of the encodings
ENCODINGS = {"UTF-8": "utf-8", "Windows-1252 (Excel)": "cp1252", "Latin-1": "latin-1", "UTF-16": "utf-16"}
AUTO_ORDER = ["utf-8", "cp1252", "latin-1", "utf-16"]
_JAVA = {"utf-8": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1", "utf-16": "UTF-16LE"}
_CODEC = {"UTF-8": "utf-8", "windows-1252": "cp1252", "ISO-8859-1": "latin-1", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}

# fixed values: pandas' default NA words (trap T-3): cells equal to one of these are empty.
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


# bytes that cp1252 leaves undefined, as Latin-1 characters
_NOT_CP1252 = "[\u0081\u008d\u008f\u0090\u009d]"


def _detected(spark: SparkSession, path) -> DataFrame:
    """(file, encoding, big): decided on executors from the lines of each file; ``big`` is a big-endian UTF-16 mark."""
    raw = lines(spark, path if isinstance(path, list) else [path], "UTF-8")
    latin = F.decode("line", "ISO-8859-1")
    first = F.when(F.col("block") == 0, F.struct("id", F.hex(F.substring("line", 1, 2)).alias("mark")))
    marks = raw.groupBy("file").agg(
        F.min(first)["mark"].alias("mark"), F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("utf8"),
        F.bool_or(latin.rlike(_NOT_CP1252)).alias("other"))
    enc = (F.when(F.col("mark").isin("FFFE", "FEFF"), "utf-16").when(F.col("utf8"), "utf-8")
           .when(~F.col("other"), "cp1252").otherwise("latin-1"))
    return marks.select("file", enc.alias("encoding"), (F.col("mark") == "FEFF").alias("big"))


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: ``(path, encoding)`` for every file under ``path`` that is not empty; decided on executors."""
    return _detected(spark, path).select(F.col("file").alias("path"), "encoding")


@dataclass(frozen=True)
class CsvGroup:
    """Files that can be read together: one encoding and one header."""

    encoding: str
    names: list[str]
    paths: list[str]
    java: str
    states: DataFrame


def csv_groups(spark: SparkSession, path: str, encoding: str | None = None) -> list[CsvGroup]:
    """Groups of the files under ``path``.  One row per file reaches the driver: its path,
    encoding and first record, which must end within the first split."""
    by_encoding: dict[tuple[str, str], list[str]] = {}
    for r in _detected(spark, path).orderBy("file").collect():
        name = encoding or r.encoding
        java = ("UTF-16BE" if r.big else "UTF-16LE") if name == "utf-16" else _JAVA.get(name, name)
        by_encoding.setdefault((name, java), []).append(unquote(r.file))
    groups: dict[tuple, list] = {}
    for (name, java), paths in by_encoding.items():
        states = split_states(spark, paths, java, _CODEC.get(java, name))
        for r in states.where("block = 0").select("file", "head").orderBy("file").collect():
            if r.head is None:
                raise ValueError(f"the header of {r.file} does not end within its first split")
            record = next(csv.reader(io.StringIO(r.head)), [])
            names = tuple(c if c != "" else f"Unnamed: {i}" for i, c in enumerate(record))
            groups.setdefault((name, java, names), [[], states])[0].append(r.file)
    return [CsvGroup(name, list(names), [unquote(f) for f in files], java, states.where(F.col("file").isin(files)))
            for (name, java, names), (files, states) in sorted(groups.items(), key=lambda g: g[1][0][0])]


def _read_group(spark: SparkSession, group: CsvGroup, na_words: list[str] | None) -> DataFrame:
    """Cells of a group as text ``c0 … cn`` with a dense ``row_pos``; files are split whatever their quotes."""
    columns = [f"c{i}" for i in range(len(group.names))]
    records = read_records(spark, group.paths, group.java, _CODEC.get(group.java, group.encoding), group.states)
    cells = records.select("row_pos", F.from_csv("record", ", ".join(f"{c} string" for c in columns),
                                                 {"escape": '"', "mode": "PERMISSIVE"}).alias("r"))
    words = NA_WORDS if na_words is None else na_words
    return cells.select(*[F.when(F.col(f"r.{c}").isin(words), F.lit(None)).otherwise(F.col(f"r.{c}")).alias(c) for c in columns],
                        "row_pos")


def read_wide_csv(spark: SparkSession, path: str, encoding: str | None = None,
                  na_words: list[str] | None = None) -> tuple[DataFrame, list[str], str]:
    """SRC-1: read wide CSV of one encoding and header (header = labels, all cells as text).

    Returns (wide frame with ``row_pos``, header names, encoding used).  Columns
    are addressed by position, so duplicate or case-equal names survive (trap T-4).
    """
    groups = csv_groups(spark, path, encoding)
    if not groups:
        return spark.createDataFrame([], "row_pos bigint"), [], encoding or "utf-8"
    if len(groups) > 1:
        raise ValueError("the files differ in encoding or header: csv_corpus reads them")
    return _read_group(spark, groups[0], na_words), groups[0].names, groups[0].encoding


def csv_corpus(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """SRC-1 + SRC-3 + SRC-4: wide CSV files → long corpus with labels named by their headers.

    Every file is read in its own encoding.  The columns of later groups follow
    those of earlier ones; equal names are one label, at its first position.
    """
    out, first, at = None, {}, 0
    for group in csv_groups(spark, path, encoding):
        names = group.names
        wide = _read_group(spark, group, None)
        cells = wide_to_corpus(wide, [f"c{i}" for i in range(len(names))])
        for i, n in enumerate(names):
            first.setdefault(n, at + i)
        # phrase ids keep the column of the cell itself, labels take their first column
        shift = F.shiftleft(F.lit(at).cast("long"), 40)
        name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("intent_pos") + 1).cast("int"))
        pos = F.element_at(F.array(*[F.lit(first[n]).cast("long") for n in names]), (F.col("intent_pos") + 1).cast("int"))
        cells = cells.select((F.col("phrase_id") + shift).alias("phrase_id"), name.alias("intent"), pos.alias("intent_pos"),
                             "row_pos", "phrase")
        out = cells if out is None else out.unionByName(cells)
        at += len(names)
    return out if out is not None else wide_to_corpus(spark.createDataFrame([], "row_pos bigint"), [])
