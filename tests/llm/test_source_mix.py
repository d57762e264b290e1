from collections import defaultdict

from pyspark.sql import functions as F

from corpuscope.llm import source_mix as sm

SCHEMA = "doc_id long, text string, source string, lang string, P int, mix_p string, topic int"


def rows_of():
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        text = "word " * (5 + i * 7919 % 60) + ("| " * 9 if i % 5 == 0 else "") + ("why?" if i % 4 == 0 else "")
        rows.append((i, text, source, ["en", "de", "fr"][i * i % 11 % 3], 1, "x", 2))
    return rows + [(None, "null id words", "s1", "en", None, None, None), (4000, None, None, None, 0, "", 0), (4001, "", "s2", None, 0, "", 0), rows[5]]


def test_raked_weights_meet_every_target(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(4)
    fitted = sm.fit(df, budget=0.3)
    for r in sm.marginal_shares(fitted).collect():
        assert abs(r.achieved - r.attainable) < 2e-3 and abs(r.achieved - r.target) < 2e-3, r  # the budget allows all targets
    assert all(0 <= r.p <= 1 for r in fitted.collect())


def brute_attainable(have, power, budget):
    """Words of each value by filling up in small steps."""
    share = {k: v ** power for k, v in have.items()}
    took, left = dict.fromkeys(have, 0.0), budget * sum(have.values())
    while left > 1e-9 * sum(have.values()):
        open_ = {k: share[k] for k in have if have[k] - took[k] > 1e-12 * sum(have.values())}
        if not open_:
            break
        step = min(min((have[k] - took[k]) / s for k, s in open_.items()), left / sum(open_.values()))
        for k, s in open_.items():
            took[k] += step * s
            left -= step * s
    return took


def test_attainable_amounts(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(4)
    for budget in (0.2, 0.7, 0.95, 1.0):
        fitted = sm.fit(df, budget=budget, rounds=1).collect()
        for name, power in sm.POWERS.items():
            have, got = defaultdict(float), {}
            for r in fitted:
                have[r[name]] += r.w0
                got[r[name]] = r["a_" + name]
            want = brute_attainable({k: v for k, v in have.items()}, power, budget)
            assert all(abs(got[k] - want[k]) < 1e-6 * sum(have.values()) for k in have), (budget, name)


def test_documents_reach_their_shares(spark):
    """Expected and sampled shares of the registered parameters against what can be attained."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fitted = sm.fit(docs)
    shares = {(r.marginal, r.value): r for r in sm.marginal_shares(fitted).collect()}
    assert all(abs(r.achieved - r.attainable) < 0.01 * r.attainable + 1e-4 for r in shares.values()), max(
        abs(r.achieved / r.attainable - 1) for r in shares.values())
    total = fitted.agg(F.sum("w0").alias("all"), F.sum("w").alias("take")).first()
    assert abs(total.take / total.all - sm.BUDGET) < 0.01
    got = sm.mix(docs, fitted).filter("sampled").join(docs.select("doc_id", sm.words().alias("n")), "doc_id")
    taken = got.agg(F.sum("n")).first()[0]
    for name in sm.POWERS:
        for r in got.groupBy(name).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") * (1 - F.col("p"))).alias("v")).collect():
            want = shares[name, r[name]].attainable
            assert abs(r.n / taken - want) < 5 * (r.v ** 0.5) / taken + 0.02 * want, (name, r[name], r.n / taken, want)


def test_sample_follows_the_probabilities(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(4)
    fitted = sm.fit(df, budget=0.5)
    got = sm.mix(df, fitted).collect()
    assert len(got) == df.count() and all(r.sampled == (r.u < r.p) and 0 <= r.u < 1 and 0 <= r.p <= 1 for r in got)
    total = fitted.agg(F.sum("w0").alias("w"), F.sum(F.col("w0") * F.col("p")).alias("taken")).first()
    assert abs(total.taken / total.w - 0.5) < 0.02
    by = defaultdict(list)
    for r in got:
        by[(r.source, r.lang, r.topic)].append(r)
    for cell in by.values():
        n, p = len(cell), cell[0].p
        assert abs(sum(r.sampled for r in cell) - n * p) <= 5 * (n * p * (1 - p)) ** 0.5 + 1
    out = sm.sample(df, fitted)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in got if r.sampled)


def test_shuffled_and_single_partition_raking_agree(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    one = {(r.source, r.lang, r.topic): r.p for r in sm.fit(df).collect()}
    monkeypatch.setattr(sm, "ONE_PARTITION_CELLS", 0)
    two = {(r.source, r.lang, r.topic): r.p for r in sm.fit(df).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    fitted = sm.fit(df)
    assert sm.mix(df, fitted).collect() == [] and sm.sample(df, fitted).collect() == []
