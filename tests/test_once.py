"""Views of all conflicts: the all-pairs job is run once, and no pair carries what the view does not show."""

import numpy as np
from pyspark.sql import functions as F

from corpuscope.operators import recommend as R
from corpuscope.operators import similarity as S
from corpuscope.plans import q_sinks
from corpuscope.sinks import files as SK
from tests.conftest import emb_corpus


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


def _tables(spark, root, n=80):
    rng = np.random.default_rng(13)
    spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)], i % 3) for i in range(n)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([(i, f"words of text {i % 50} with number {i % 9}") for i in range(n)],
                          "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    return str(root)


def _conflicts(spark, n=90):
    rng = np.random.default_rng(8)
    corpus = emb_corpus(spark, [(i, f"l{i % 3}", f"alpha beta word{chr(97 + i % 20)} alpha zeta", rng.normal(size=4)) for i in [*range(n), 5, 6]])
    phrases = S.phrase_index(corpus)
    return corpus, phrases, S.place_pairs(S.conflict_pairs(corpus, 0.3), phrases)


def test_sheets_of_the_bundle_read_the_written_conflicts(spark, tmp_path, monkeypatch):
    made, make = {}, SK.analysis_bundle
    monkeypatch.setattr(SK, "analysis_bundle", lambda *tables: made.update(make(*tables)) or dict(made))
    out = {r["sheet"]: r["n_rows"] for r in q_sinks.q_analysis_bundle(spark, _tables(spark, tmp_path)).collect()}
    assert {"Summary", "Priority_Actions"} < set(out) <= set(made) and out["All_Phrase_Conflicts"] > 100
    for name in ("Summary", "Priority_Actions", "All_Phrase_Conflicts"):
        assert "MapInArrow" not in _plan(made[name]), name
    assert dict(map(tuple, made["Summary"].collect()))["Total Phrase Conflicts"] == str(out["All_Phrase_Conflicts"])


def test_ranges_of_similarity_need_no_sample_of_all_pairs(spark, tmp_path):
    corpus, phrases, placed = _conflicts(spark)
    bounds = S.similarity_bounds(corpus, 0.3)
    assert bounds == sorted(bounds) and bounds[0] >= 0.3
    for few in (True, False):
        phrases.few = few
        dealt = S.dealt_by_similarity(placed, phrases, bounds)
        assert "direct_shuffle_partition_id" in _plan(dealt) and "sim" not in _plan(dealt).split("direct_shuffle_partition_id", 1)[1].split("]")[0]
        assert _rows(dealt) == _rows(placed)
    path = SK.write_named_csv(dealt.select("sim", "phrase_id", "other_id"), str(tmp_path), "full_confusion_report", dealt=True)
    files = sorted((tmp_path / "full_confusion_report").glob("part-*"))
    sims = [r[0] for f in files for r in spark.read.option("header", True).schema("sim double").csv(str(f)).collect()]
    assert path and len(files) > 2 and sims == sorted(sims, reverse=True) and len(sims) == placed.count()
    assert S.similarity_bounds(corpus, 2.0) == []


def test_counted_actions_do_not_meet_words_in_every_pair(spark):
    corpus, _, placed = _conflicts(spark)
    every = R.phrase_actions(placed, corpus)
    counted = R.phrase_actions(placed, corpus, columns=["action"])
    assert "array_except" in _plan(every) and "array_except" not in _plan(counted)
    # ids that repeat count as often as they did
    assert _rows(R.action_counts(counted)) == _rows(R.action_counts(every))
    assert _plan(counted).count("MapInArrow") == 1
    some = ["phrase_id", "action", "current_intent", "similarity", "reason"]
    assert _rows(R.phrase_actions(placed, corpus, columns=some)) == _rows(every.select(*some))
    assert R.phrase_actions(placed, corpus, columns=["action", "common_words"]).columns == ["action", "common_words"]


def test_words_are_sorted_once_per_text(spark):
    corpus, _, placed = _conflicts(spark)
    actions = R.phrase_actions(placed, corpus)
    assert "array_sort" not in _plan(actions) and "array_distinct" not in _plan(actions)
    row = actions.where(F.col("add_to_current") != "N/A").first()
    assert row["common_words"] == "alpha, beta, zeta" and row["add_to_current"].startswith("word")
