"""Sinks: CSV / JSON / text / Parquet outputs, bundles, project snapshots and
the search history (SNK-1 … SNK-18, SRC-6, AGG-23).

Every writer is a plain ``DataFrameWriter`` call on distributed data; nothing
is collected to the driver.  Excel workbooks become one dataset per sheet and
pickled projects become one Parquet table per part.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FILE_ROWS = 20_000


def write_csv(df: DataFrame, path: str, order: list | None = None, single_file: bool = False, compression: str = "none") -> str:
    """SNK-1 … SNK-9: header CSV, optionally sorted first (e.g. sim desc for SNK-3)."""
    out = df.orderBy(*order) if order else df
    if single_file:
        out = out.coalesce(1)   # only for small, bounded outputs (display-sized reports)
    # files of so many rows at most: a file whose cells hold line breaks is read by one task
    (out.write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", FILE_ROWS).option("compression", compression)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))  # cells as they are
    return path


# fixed values: names of the CSV outputs, with the order of their rows
CSV_OUTPUTS = {
    "exact_duplicates": ["intent_pos", "row_pos", "other_pos", "other_row"],       # SNK-2
    "full_confusion_report": [F.desc, "sim"],                                       # SNK-3
    "priority_actions": ["seq"],                                                    # SNK-4
    "phrase_actions": [F.desc, "similarity"],                                       # SNK-5
    "modified_dataset": ["rn"],                                                     # SNK-6
    "search_results": ["query_id", "rank"],                                         # SNK-7
    "search_history": ["batch", "seq"],                                             # SNK-8
    "batch_audit": ["query_id"],                                                    # SNK-9
}


def write_named_csv(df: DataFrame, root: str, name: str, dealt: bool = False, compression: str = "none") -> str:
    """SNK-2 … SNK-9: one of the named outputs, in its order, as ``root/name``; ``dealt`` rows are in ranges of that
    order already, and are sorted within them."""
    order = CSV_OUTPUTS[name]
    keys = [F.desc(order[1])] if order[0] is F.desc else [F.col(c) for c in order]
    path = os.path.join(root, name)
    return write_csv(df.sortWithinPartitions(*keys), path, compression=compression) if dealt else write_csv(df, path, keys, compression=compression)


def analysis_bundle(summary: DataFrame, pairs: DataFrame, actions: DataFrame, conflicts: DataFrame,
                    matrix: DataFrame) -> dict[str, DataFrame]:
    """SNK-10: the five tables of the analysis workbook under their sheet names (fixed values)."""
    return {"Summary": summary.select("metric", "value"),
            "Confusing_Intent_Pairs": pairs.select("intent_a", "intent_b", F.col("sim3").alias("similarity"), "risk"),
            "Priority_Actions": actions, "All_Phrase_Conflicts": conflicts, "Intent_Similarity_Matrix": matrix}


def search_bundle(summary: DataFrame, distribution: DataFrame, results: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """SNK-11: the four tables of the search workbook; ``results`` carries ``rank``."""
    return {"Summary": summary, "Intent_Distribution": distribution, "All_Results": results,
            "Top_10_Matches": results.where(F.col("rank") <= top)}


#: SNK-10 / SNK-11: sheets that are left out when they have no rows.
SKIP_EMPTY = ("Confusing_Intent_Pairs", "Priority_Actions", "All_Phrase_Conflicts", "Intent_Distribution")


def write_bundle(tables: dict[str, DataFrame], root: str, fmt: str = "parquet",
                 skip_empty: tuple[str, ...] = ()) -> list[str]:
    """SNK-10 / SNK-11: one dataset per sheet; sheets named in ``skip_empty`` are
    written only when they have rows (the reference omits them when empty)."""
    written = []
    for name, df in tables.items():
        if name in skip_empty and df.limit(1).count() == 0:
            continue
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(os.path.join(root, name))
        written.append(name)
    return written


def search_document(hits: DataFrame, queries: DataFrame, decision: DataFrame, threshold: float,
                    timestamp: str) -> DataFrame:
    """SNK-12: one nested JSON document per query (query, threshold, timestamp,
    summary, results ordered by rank).  A result has ``match_type`` and
    ``keywords`` when ``hits`` (see ``search.result_table``) has them."""
    # fixed values: the keys of the documents
    more = [c for c in ("match_type", "keywords") if c in hits.columns]
    res = hits.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "sim", "intent", "phrase", *more))),
        lambda s: F.struct(s["sim"].alias("similarity"), s["intent"].alias("intent"), s["phrase"].alias("phrase"),
                           *[s[c].alias(c) for c in more])).alias("results"),
        F.count(F.lit(1)).alias("total_results"), F.count_distinct("intent").alias("unique_intents"),
        F.max("sim").alias("top_similarity"))
    j = queries.select("query_id", "query").join(res, "query_id", "left").join(
        decision.select("query_id", F.col("dominant_intent").alias("recommended_intent")), "query_id", "left")
    return j.select("query_id", F.struct(
        F.col("query"), F.lit(threshold).alias("threshold"), F.lit(timestamp).alias("timestamp"),
        F.struct(F.coalesce("total_results", F.lit(0)).alias("total_results"),
                 F.coalesce("unique_intents", F.lit(0)).alias("unique_intents"),
                 F.col("top_similarity"), F.col("recommended_intent")).alias("summary"),
        F.coalesce("results", F.array()).alias("results")).alias("doc"))


def write_json_documents(docs: DataFrame, path: str) -> str:
    docs.select(F.to_json("doc").alias("value")).write.mode("overwrite").text(path)
    return path


def write_report(lines: DataFrame, path: str) -> str:
    """SNK-13: text report lines in order (a report is a handful of lines)."""
    lines.orderBy("line_no").select("text").coalesce(1).write.mode("overwrite").text(path)
    return path


# ---------------------------------------------------------------------------
# project snapshots (SNK-14 … SNK-16, SRC-6, AGG-23)
# ---------------------------------------------------------------------------
#
# project=<name>/data/<save>/<part>        one Parquet table per part
# project=<name>/manifests/<number>.json   name, folder of each part; written last
#
# A project is what its newest complete manifest lists.  Tables are written to new
# folders first, and the manifest is moved into place as a whole, so a save that
# stops half way leaves the project as it was.  Folders that neither of the two
# newest manifests lists are removed after the next save.

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _base(root: str, name: str) -> str:
    return os.path.join(root, f"project={name}")


def _manifests(spark: SparkSession, base: str) -> list[tuple[int, dict[str, str]]]:
    """(number, part folders) of the complete manifests, newest first."""
    out = []
    for file in _children(spark, os.path.join(base, "manifests")):
        number = file.removesuffix(".json")
        if not number.isdigit():
            continue  # being written when its save stopped
        p, fs = _fs(spark, os.path.join(base, "manifests", file))
        stream = fs.open(p)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        out.append((int(number), json.loads(text)))
    return sorted(out, key=lambda m: m[0], reverse=True)


def _publish(spark: SparkSession, base: str, parts: dict[str, str]) -> None:
    """Write the next manifest aside and move it into place."""
    held = _manifests(spark, base)
    number = held[0][0] + 1 if held else 1
    aside, fs = _fs(spark, os.path.join(base, "manifests", f"_writing-{uuid.uuid4().hex[:12]}"))
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
    stream.close()
    final, _ = _fs(spark, os.path.join(base, "manifests", f"{number:012d}.json"))
    if not fs.rename(aside, final):
        raise OSError(f"another save published {final.toString()} first")


def _clean(spark: SparkSession, base: str) -> None:
    """Remove manifests older than the two newest, and folders that those do not list."""
    held = _manifests(spark, base)
    for number, _ in held[2:]:
        p, fs = _fs(spark, os.path.join(base, "manifests", f"{number:012d}.json"))
        fs.delete(p, False)
    listed = {folder.split("/")[1] for _, parts in held[:2] for folder in parts.values()}
    for save in _children(spark, os.path.join(base, "data")):
        if save not in listed:
            p, fs = _fs(spark, os.path.join(base, "data", save))
            fs.delete(p, True)


def _write_parts(base: str, parts: dict[str, DataFrame]) -> dict[str, str]:
    save = f"data/{uuid.uuid4().hex[:12]}"
    for part, df in parts.items():
        df.write.option("compression", "zstd").parquet(os.path.join(base, save, part))
    return {part: f"{save}/{part}" for part in parts}


def save_project(root: str, name: str, parts: dict[str, DataFrame], meta: dict[str, str]) -> str:
    """SNK-14: one Parquet table per part plus a one-row ``_meta`` table.

    Saving replaces the whole project as one step; parts may be read from the project that
    they replace.  Two saves at once do not mix: one of them fails.
    """
    base = _base(root, name)
    spark = next(iter(parts.values())).sparkSession if parts else SparkSession.getActiveSession()
    meta_row = spark.createDataFrame([tuple(meta.values())], ", ".join(f"{k} string" for k in meta))
    folders = _write_parts(base, {**parts, "_meta": meta_row})
    _publish(spark, base, folders)
    _clean(spark, base)
    return base


def load_project(spark: SparkSession, root: str, name: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """SRC-6: read every part of the newest complete save, whatever its name; a missing
    optional part is an empty frame with the given schema."""
    base = _base(root, name)
    held = _manifests(spark, base)
    if not held:
        raise FileNotFoundError(f"Project not found: {base}")
    out = {part: spark.read.parquet(os.path.join(base, folder)) for part, folder in held[0][1].items()}
    for part, schema in (schemas or {}).items():
        if part not in out:
            out[part] = spark.createDataFrame([], schema)
    return out


def list_projects(spark: SparkSession, root: str) -> DataFrame:
    """SNK-15: (name, size_mb, modified) in name order, from file metadata only."""
    rows = []
    for folder in _children(spark, root):
        held = _manifests(spark, os.path.join(root, folder)) if folder.startswith("project=") else []
        if not held:
            continue
        size = 0
        for part in held[0][1].values():
            p, fs = _fs(spark, os.path.join(root, folder, part))
            size += fs.getContentSummary(p).getLength()
        p, fs = _fs(spark, os.path.join(root, folder, "manifests", f"{held[0][0]:012d}.json"))
        rows.append((folder.removeprefix("project="), size, fs.getFileStatus(p).getModificationTime()))
    found = spark.createDataFrame(rows, "name string, size long, ms long")
    return found.select("name", F.round(F.col("size") / (1024 * 1024), 2).alias("size_mb"),
                        F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd HH:mm").alias("modified")).orderBy("name")


def delete_project(spark: SparkSession, root: str, name: str) -> None:
    """SNK-16: remove a project's folder; no error if it is absent."""
    p, fs = _fs(spark, _base(root, name))
    if fs.exists(p):
        fs.delete(p, True)


BASELINE = ("baseline_pairs", "baseline_conflicts", "baseline_matrix", "baseline_corpus")


def set_baseline(root: str, name: str, pairs: DataFrame, conflicts: DataFrame, matrix: DataFrame,
                 corpus: DataFrame | None = None) -> None:
    """AGG-23: the current pairs, conflicts and matrix become the baseline; with the corpus they came
    from, later conflicts follow from the changed phrases alone (``incremental.update_conflicts``)."""
    spark, base = pairs.sparkSession, _base(root, name)
    parts = dict(zip(BASELINE, (pairs, conflicts, matrix, corpus)))
    folders = _write_parts(base, {k: v for k, v in parts.items() if v is not None})
    held = _manifests(spark, base)
    kept = {k: v for k, v in (held[0][1] if held else {}).items() if k not in BASELINE}
    _publish(spark, base, {**kept, **folders})
    _clean(spark, base)


def reset_baseline(spark: SparkSession, root: str, name: str) -> None:
    """AGG-23: the project without its baseline."""
    base = _base(root, name)
    held = _manifests(spark, base)
    if held and any(k in BASELINE for k in held[0][1]):
        _publish(spark, base, {k: v for k, v in held[0][1].items() if k not in BASELINE})
        _clean(spark, base)
