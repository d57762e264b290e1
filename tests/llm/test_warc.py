import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuscope.llm import warc
from corpuscope.llm.files import open_store

SCHEMA = "page_id long, url string, html string, digest string, OFFSET int"


def brute(rows):
    body = [(r[2] or "").encode() for r in rows]
    groups = defaultdict(list)
    for r, b in zip(rows, body):
        groups[b].append(r[0])
    out = []
    for r, b in zip(rows, body):
        ids = [x for x in groups[b] if x is not None]
        head = max(ids, default=None) if len(b) >= 1000 and len(groups[b]) > 1 else r[0]
        again = head is not None and r[0] != head
        out.append((r[0], len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


def rows_of():
    rnd = random.Random(11)
    same = ["é" * 600, "x" * 999, "y" * 1000, "<html>" + "z" * 5000]
    rows = [(i, f"http://h{i}.example/é?q=1\r\nX: y", rnd.choice(same + [f"page {i} " * rnd.randrange(0, 900)]), "x", 1) for i in range(300)]
    return rows + [(None, None, same[0], None, None), (None, "", None, "", 0), (900, "", "", "", 0), (901, "u", "\r\n\r\nWARC/1.0\r\n" * 99, "", 0),
                   rows[3], rows[4], rows[4], (max(r[0] for r in rows if r[2] == same[3]), "again", same[3], "", 0), (902, "u", "\x00" * 70_000, "", 0)]


@pytest.mark.parametrize("archive_bytes", [5000, warc.ARCHIVE_BYTES])
def test_records_come_back(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    monkeypatch.setattr(warc, "RANGE_BYTES", 30_000)
    rows = rows_of()
    index = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = warc.resolve_revisits(warc.read_records(index, with_payload=True).cache())
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == brute(rows)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got.collect() if r.record_type == "response")
    # another reader: the archives are plain concatenated gzip members
    raw = []
    for path in sorted({r.archive for r in index.collect()}):
        store, at = open_store(path)
        with store.open_input_file(at) as f:
            raw.append(gzip.decompress(f.read()))
    assert sum(x.count(b"WARC-Type: ") for x in raw) == len(rows)
    # selected records only
    few = index.filter("page_id % 50 = 0")
    assert {r.page_id for r in warc.read_records(few).collect()} == {r[0] for r in rows if r[0] is not None and r[0] % 50 == 0}
    assert index.filter(F.col("length") <= 0).count() == 0


def test_ranges_are_coalesced():
    got = list(warc._ranges([(0, 100), (100, 50), (200, 10), (10_000_000, 5), (10_000_010, 9_000_000), (19_000_020, 3)]))
    assert [len(g) for g in got] == [3, 1, 1, 1]


def test_empty_table(spark):
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], SCHEMA))).collect() == []
