import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import corpus_of
from corpuscope.sinks import files as SK
from corpuscope.sources.corpus import queries_from_files, queries_from_text
from corpuscope.sources.csv_intents import csv_corpus, detect_encodings, read_wide_csv
from corpuscope.streaming import history as HI


def _scratch():
    return tempfile.mkdtemp(prefix="cs-test-", dir="/tmp")


def test_csv_utf8_auto(spark):                                     # A1
    d = _scratch()
    p = os.path.join(d, "a.csv")
    open(p, "w", encoding="utf-8").write("greeting,farewell\nhello,goodbye\nhi,bye\n")
    wide, names, enc = read_wide_csv(spark, p)
    assert enc == "utf-8" and names == ["greeting", "farewell"] and wide.count() == 2


def test_csv_named_encoding_keeps_text(spark):                     # A2
    d = _scratch()
    p = os.path.join(d, "a.csv")
    open(p, "w", encoding="utf-8").write("a,b\n1,2\n")
    c = csv_corpus(spark, p, "utf-8").orderBy("phrase_id").collect()
    assert [(r.intent, r.phrase) for r in c] == [("a", "1"), ("b", "2")]


def test_encodings_give_same_corpus(spark):                        # B2, T-1, T-2
    d = _scratch()
    text = "greeting,farewell\ncafé,adiós\n"
    for enc, name in [("utf-8", "u8"), ("cp1252", "cp"), ("latin-1", "l1"), ("utf-16", "u16")]:
        sub = os.path.join(d, name)
        os.makedirs(sub)
        open(os.path.join(sub, "x.csv"), "wb").write(text.encode(enc))
    got = {}
    for name in ["u8", "cp", "l1", "u16"]:
        c = csv_corpus(spark, os.path.join(d, name))
        got[name] = sorted((r.intent, r.phrase) for r in c.collect())
    assert all(v == [("farewell", "adiós"), ("greeting", "café")] for v in got.values()), got
    encs = {os.path.basename(os.path.dirname(r.path)): r.encoding for r in detect_encodings(spark, d + "/*/*.csv").collect()}
    assert encs["u16"] == "utf-16" and encs["u8"] == "utf-8"


def test_every_file_in_its_own_encoding(spark):                   # SRC-2
    d = _scratch()
    text = "greeting,farewell\nna\u00efve,\u00e9t\u00e9\n\"two\nlines\",plain\n"
    for enc in ("utf-8", "cp1252", "utf-16"):
        open(os.path.join(d, f"{enc}.csv"), "wb").write(text.encode(enc))
    open(os.path.join(d, "z.csv"), "wb").write("farewell,other\nlast,word\n".encode())
    open(os.path.join(d, "empty.csv"), "wb").write(b"")
    c = csv_corpus(spark, d).collect()
    got = sorted((r.intent, r.phrase) for r in c)
    assert got == sorted(3 * [("greeting", "na\u00efve"), ("farewell", "\u00e9t\u00e9"), ("greeting", "two\nlines"), ("farewell", "plain")]
                         + [("farewell", "last"), ("other", "word")])
    assert len({r.phrase_id for r in c}) == len(c)
    assert len({r.intent_pos for r in c if r.intent == "farewell"}) == 1


def test_rows_keep_their_order_without_quotes(spark):              # SRC-1, split files
    d = _scratch()
    open(os.path.join(d, "a.csv"), "w").write("a,b\n" + "".join(f"x{i},y{i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        c = csv_corpus(spark, d).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.phrase for r in sorted(c, key=lambda r: r.phrase_id)] == [f"x{i}" for i in range(500)] + [f"y{i}" for i in range(500)]


def test_duplicate_headers_survive(spark):                         # T-4
    d = _scratch()
    p = os.path.join(d, "a.csv")
    open(p, "w").write("Greeting,greeting\nhi,hello\n")
    c = csv_corpus(spark, p, "utf-8")
    assert sorted(r.intent for r in c.collect()) == ["Greeting", "greeting"]


def test_queries_from_text(spark):                                 # SRC-5
    q = queries_from_text(spark, "  a \n\n b\n  \n")
    assert [r.query for r in q.orderBy("query_id").collect()] == ["a", "b"]
    d = _scratch()
    open(os.path.join(d, "q.txt"), "w").write("first query\n   \n second one \n")
    f = queries_from_files(spark, d)
    assert [r.query for r in f.orderBy("query_id").collect()] == ["first query", "second one"]


def test_bundle_json_report_roundtrip(spark):                      # SNK-1, SNK-10, SNK-12, SNK-13
    d = _scratch()
    c = corpus_of(spark, {"a": ["x", "y"], "b": ["z"]})
    SK.write_csv(c, os.path.join(d, "csv"), order=["phrase_id"])
    assert spark.read.option("header", True).csv(os.path.join(d, "csv")).count() == 3
    empty = c.where(F.lit(False))
    written = SK.write_bundle({"Summary": c, "Confusing_Intent_Pairs": empty}, os.path.join(d, "bundle"),
                              skip_empty=("Confusing_Intent_Pairs",))
    assert written == ["Summary"]
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "line_no bigint, text string")
    SK.write_report(lines, os.path.join(d, "rep"))
    assert [r.value for r in spark.read.text(os.path.join(d, "rep")).collect()] == ["a", "b"]
    hits = spark.createDataFrame([(0, 1, 0.9, "a", "x")], "query_id bigint, rank int, sim double, intent string, phrase string")
    qs = spark.createDataFrame([(0, "q"), (1, "r")], "query_id bigint, query string")
    dec = spark.createDataFrame([(0, "a")], "query_id bigint, dominant_intent string")
    SK.write_json_documents(SK.search_document(hits, qs, dec, 0.5, "t"), os.path.join(d, "json"))
    docs = [json.loads(r.value) for r in spark.read.text(os.path.join(d, "json")).collect()]
    assert sorted(x["summary"]["total_results"] for x in docs) == [0, 1]


def test_project_snapshot_cycle(spark):                            # SNK-14 … 16, SRC-6, AGG-23
    root = _scratch()
    c = corpus_of(spark, {"a": ["x"]})
    SK.save_project(root, "p1", {"corpus": c}, {"model_name": "m", "saved_at": "t"})
    SK.set_baseline(root, "p1", c, c, c)
    loaded = SK.load_project(spark, root, "p1", {"search_history": HI.HISTORY_SCHEMA})
    assert loaded["corpus"].count() == 1 and loaded["search_history"].count() == 0
    assert loaded["_meta"].first().model_name == "m" and "baseline_pairs" in loaded
    SK.reset_baseline(spark, root, "p1")
    assert "baseline_pairs" not in SK.load_project(spark, root, "p1")
    assert [r.name for r in SK.list_projects(spark, root).collect()] == ["p1"]
    SK.delete_project(spark, root, "p1")
    SK.delete_project(spark, root, "p1")          # absent: no error
    assert SK.list_projects(spark, root).count() == 0


def test_a_save_that_stops_leaves_the_project(spark, monkeypatch):  # SNK-14
    import pytest

    root = _scratch()
    frame = lambda *words: corpus_of(spark, {"a": list(words)})
    SK.save_project(root, "p", {"corpus": frame("x")}, {"saved_at": "1"})
    publish = SK._publish

    def stop(*_):
        raise KeyboardInterrupt
    monkeypatch.setattr(SK, "_publish", stop)                      # after the tables, before the manifest
    with pytest.raises(KeyboardInterrupt):
        SK.save_project(root, "p", {"corpus": frame("x", "y")}, {"saved_at": "2"})
    open(os.path.join(root, "project=p", "manifests", "_writing-1"), "w").write("{")   # half a manifest
    loaded = SK.load_project(spark, root, "p")
    assert loaded["corpus"].count() == 1 and loaded["_meta"].first().saved_at == "1"
    monkeypatch.setattr(SK, "_publish", publish)
    for i in range(3, 6):  # parts read from the project they replace
        SK.save_project(root, "p", {"corpus": SK.load_project(spark, root, "p")["corpus"].union(frame(f"w{i}"))}, {"saved_at": str(i)})
    assert SK.load_project(spark, root, "p")["corpus"].count() == 4
    assert len(os.listdir(os.path.join(root, "project=p", "data"))) == 2
    assert [r.name for r in SK.list_projects(spark, root).collect()] == ["p"]
    SK.set_baseline(root, "p", frame("a"), frame("b"), frame("c"), frame("d"))
    SK.reset_baseline(spark, root, "p")
    assert set(SK.load_project(spark, root, "p")) == {"corpus", "_meta"}


def test_history_append_recent_clear(spark):                       # SNK-17, SNK-18, LIM-8
    path = os.path.join(_scratch(), "hist")
    assert HI.read_history(spark, path).count() == 0
    HI.clear_history(spark, path)
    for i in range(25):
        rec = spark.createDataFrame([(i // 10, i, "t", f"q{i}", 0.5, 1, 0.9, "a")], HI.HISTORY_SCHEMA)
        HI.append_history(rec, path)
    r = HI.recent(HI.read_history(spark, path), 20).collect()
    assert len(r) == 20 and r[0].seq == 24
    assert [x.seq for x in HI.newest(spark, path, 3).collect()] == [24, 23, 22]
    assert [x.seq for x in HI.newest(spark, path, 7).collect()] == list(range(24, 17, -1))
    plan = HI.newest(spark, path, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "batch" in plan.split("PartitionFilters: [")[1].split("]")[0]
    HI.clear_history(spark, path)
    assert HI.read_history(spark, path).count() == 0 and HI.newest(spark, path).count() == 0


def test_history_replay_after_a_stop_between_files(spark):         # SNK-17
    path = os.path.join(_scratch(), "hist")
    rows = lambda b, n: spark.createDataFrame([(b, i, "t", f"q{b}-{i}", 0.5, 1, 0.9, "a") for i in range(n)], HI.HISTORY_SCHEMA)
    HI.append_batch(rows(0, 4).repartition(3), path, 0)
    HI.append_batch(rows(1, 6).repartition(4), path, 1)
    part = os.path.join(path, "batch=1")
    files = [f for f in os.listdir(part) if f.endswith(".parquet")]
    assert len(files) > 1
    os.rename(os.path.join(part, files[0]), os.path.join(_scratch(), files[0]))   # what a stop between two files leaves
    assert HI.read_history(spark, path).count() < 10
    HI.append_batch(rows(1, 6).repartition(2), path, 1)                           # the replay
    got = sorted((r.batch, r.seq) for r in HI.read_history(spark, path).collect())
    assert got == [(0, i) for i in range(4)] + [(1, i) for i in range(6)]


def test_entry_contract(spark):
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    assert df.count() > 0 and "is_exact" in df.columns


def test_streaming_audit_appends_history(spark):                   # streaming batch audit → SNK-17
    from corpuscope.operators.encode import HashingEncoder, encode
    d = _scratch()
    qdir = os.path.join(d, "queries")
    os.makedirs(qdir)
    open(os.path.join(qdir, "batch1.txt"), "w").write("book a flight\n\ncancel my order\n")
    docs = spark.createDataFrame([(0, "travel", 0, 0, "book a flight to paris"), (1, "orders", 1, 1, "cancel my order")],
                                 "phrase_id bigint, intent string, intent_pos bigint, row_pos bigint, phrase string")
    corpus = encode(docs, "phrase", "phrase_id", HashingEncoder(64))
    hist = os.path.join(d, "history")
    q = HI.audit_stream(spark, qdir, corpus, hist, os.path.join(d, "ckpt"), threshold=0.3, top_k=5,
                        encoder=HashingEncoder(64), available_now=True)
    q.awaitTermination(120)
    rows = HI.read_history(spark, hist).collect()
    assert sorted(r.query for r in rows) == ["book a flight", "cancel my order"]
    assert {r.recommended_intent for r in rows} == {"travel", "orders"}


def test_display_helpers(spark):                                   # LIM-9, LIM-12
    from corpuscope.operators.search import display_page, first_matches
    df = spark.range(30).withColumn("rank", (F.col("id") % 10 + 1).cast("int"))
    assert first_matches(df, 5).count() == 15
    page = display_page(df, ["id"], 25).collect()
    assert len(page) == 25 and page[0].caption == "Showing 25 of 30"
