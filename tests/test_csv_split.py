import csv
import io
import os
import random
import tempfile

import pytest

from corpuscope.sources.csv_intents import csv_corpus, read_wide_csv
from corpuscope.sources.csv_split import IN, OUT, end_state, lines


def _table(seed, rows, columns):
    rnd = random.Random(seed)
    bits = ["plain", "two\nlines", 'a "quoted" word', "x,y", "", " space ", "é€", 'end"', "\n", "a\r\nb", '""', "tail,\n\"", "5\" disk"]
    return [["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 4))) for _ in range(columns)] for _ in range(rows)]


def _write(folder, name, rows, encoding, newline="\n"):
    buf = io.StringIO()
    csv.writer(buf, lineterminator=newline).writerows([["a", "b\nb", "c"], *rows])
    open(os.path.join(folder, name), "wb").write(buf.getvalue().encode(encoding))


def _cells(rows):
    return [tuple(c if c not in ("",) else None for c in r) for r in rows if any(r)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("encoding,newline", [("utf-8", "\n"), ("utf-8-sig", "\r\n"), ("cp1252", "\n"), ("utf-16", "\n"), ("utf-16", "\r\n")])
def test_split_file_equals_the_whole_file(small_splits, encoding, newline):
    folder, rows = tempfile.mkdtemp(prefix="cs-test-", dir="/tmp"), _table(hash(newline) % 7, 300, 3)
    _write(folder, "one file.csv", rows, encoding, newline)
    wide, names, _ = read_wide_csv(small_splits, folder)
    got = [tuple(r)[:3] for r in sorted(wide.collect(), key=lambda r: r.row_pos)]
    assert names == ["a", "b\nb", "c"] and got == _cells(rows)
    assert [r.row_pos for r in sorted(wide.collect(), key=lambda r: r.row_pos)] == list(range(len(got)))
    assert lines(small_splits, [folder], "UTF-8").rdd.getNumPartitions() > 8


def test_a_record_longer_than_splits(small_splits):
    folder = tempfile.mkdtemp(prefix="cs-test-", dir="/tmp")
    rows = [["x", "line\n" * 900, "y"], ["1", "2", "3"], ["p", 'q"\n' * 500, ""], ["4", "", "6"]]
    _write(folder, "f.csv", rows, "utf-8")
    wide, _, _ = read_wide_csv(small_splits, folder)
    assert [tuple(r)[:3] for r in sorted(wide.collect(), key=lambda r: r.row_pos)] == _cells(rows)


def test_mixed_encodings_in_one_folder(small_splits):
    folder, want = tempfile.mkdtemp(prefix="cs-test-", dir="/tmp"), []
    for i, encoding in enumerate(("utf-8", "cp1252", "utf-16", "utf-8")):
        rows = _table(i, 80, 3)
        _write(folder, f"f{i}.csv", rows, encoding)
        want += [(name, c.strip()) for r in rows for name, c in zip(("a", "b\nb", "c"), r)]
    open(os.path.join(folder, "empty.csv"), "wb").close()
    got = sorted((r.intent, r.phrase) for r in csv_corpus(small_splits, folder).collect())
    assert got == sorted(w for w in want if w[1])


def test_states():
    cases = [("a,b", OUT, OUT), ('a,"b', OUT, IN), ('a,"b""', OUT, IN), ('a,"b"""', OUT, OUT), ('5" disk,x', OUT, OUT), ('x",y', IN, OUT),
             ('x"",y', IN, IN), ('x","z', IN, IN), ("plain", IN, IN), ('"a"b,"', OUT, IN), ("", OUT, OUT), ('"', OUT, IN), ('"', IN, OUT), ('"",""', OUT, OUT)]
    for line, before, after in cases:
        assert end_state(line, before) == after, (line, before)
