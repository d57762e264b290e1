import random
import re

import pyarrow.parquet as pq

from corpuscope.llm.license_scan import NOTICES, PHRASES, license_scan

SCHEMA = "doc_id long, text string, rid string, LABELS int"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc_id, text):
    words = words_of(text)
    places = [(i, label) for label, phrase in PHRASES for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def base(r):
    return (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)


def test_cases(spark):
    rnd = random.Random(4)
    notice = dict(NOTICES)
    bits = ["MIT License", "mit  license", "the Apache-License", "General, Public\nLicense", "general public", "license",
            "mit license mit license", "É", "Kit", "of the", "mit"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 14))), "x", 1) for i in range(120)]
    rows += [(200, None, "x", 1), (201, "", None, None), (202, " .,", "", 0), (203, "one", "", 0), (None, "mit license", "", 0),
             (204, "a " * 50_000 + "apache license", "", 0), rows[7], (rows[8][0], "apache license", "", 0),
             (300, "intro " + notice["bsd"] + " outro", "", 0), (301, notice["gpl-3"].upper(), "", 0),
             (302, notice["bsd"].replace("with or", "with, say, or"), "", 0), (303, "licensed under of the", "", 0)]
    got = license_scan(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(map(base, got), key=str) == sorted((brute(r[0], r[1]) for r in rows), key=str)
    by_id = {r.doc_id: r for r in got}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert by_id[300].labels == "bsd" and by_id[300].score == 1.0
    assert by_id[301].labels == "gpl,gpl-3" and by_id[301].base_labels == "gpl"
    assert by_id[302].labels == "bsd" and 0.6 < by_id[302].score < 1  # two diagonals, merged
    assert by_id[303].labels == "" and by_id[200].score == 0.0


def test_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    got = license_scan(spark.read.parquet(path)).collect()
    assert sorted(map(base, got), key=str) == sorted((brute(*r) for r in rows), key=str)
    assert sum(r.n_base for r in got) > 0


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).collect() == []
