import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq

from corpuscope.llm.personal_data import KINDS, RADIX, Reliability, SpanClassifier, digits_of, iban_valid, personal_data, spans_of

SCHEMA = "doc_id long, text string, FOUND string, code int"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, span):
    digits = [int(c) for c in span if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PATTERNS.items()
            for m in re.finditer(pattern, text or "") if passes(kind, m[0])]


def base_row(doc_id, text):
    spans = brute(text)
    return (doc_id, *[sum(s.startswith(k) for s in spans) for k in PATTERNS], hashlib.sha256(",".join(spans).encode()).hexdigest())


def check(rows, got):
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((base_row(r[0], r[1]) for r in rows), key=str)
    by_text = {(r.doc_id, r.base_sha256): set(filter(None, r.spans.split(","))) for r in got}
    for row in rows:
        assert set(brute(row[1])) <= by_text[row[0], base_row(row[0], row[1])[-1]]
    for r in got:
        places = [(KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in filter(None, r.spans.split(","))]
        assert places == sorted(places)


def test_base_spans(spark):
    rnd = random.Random(3)
    bits = ["a", "B", "7", "12", "255", "256", ".", ".", "@", "@", "-", "_", "%", "+", " ", "  ", "(", ")", "é", "😀", "4111 1111 1111 1111",
            "4111111111111112", "1.2.3.4", "+1 (743) 555-3824", "x@y.de", "000", ",", "\n", "0004", "5-5"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 40))), "x", 1) for i in range(4000)]
    rows += [(-1, None, "x", 1), (-2, "", None, None), (None, "a@b.c%d@e.f", "", 0), (None, "a@b.c@d.e", "", 0), rows[5], rows[5]]
    check(rows, personal_data(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())


def test_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [tuple(r.values()) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    got = personal_data(spark.read.parquet(path)).collect()
    check(rows, got)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 30


def iban(rnd):
    country, rest = rnd.choice(["DE", "FR", "GB"]), "".join(rnd.choice("0123456789") for _ in range(18))
    return next(f"{country}{c:02d}{rest}" for c in range(2, 99) if iban_valid(f"{country}{c:02d}{rest}"))


def made(seed, docs):
    """Texts with personal data and look-alikes, and the places of both."""
    rnd = random.Random(seed)
    d = lambda n: "".join(rnd.choice("123456789") for _ in range(n))
    first, last = ["Maria", "John", "Klaus", "Emma"], ["Keller", "Smith", "Moreau", "Ortega"]
    real = [lambda: ("my account", iban(rnd), "iban"), lambda: ("her social security number is", f"{rnd.randrange(100, 600)}-{rnd.randrange(10, 99)}-{d(4)}", "ssn"),
            lambda: ("you may call", f"({d(3)}) {d(3)}-{d(4)}", "phone"), lambda: ("please phone", f"0{d(3)} {d(3)} {d(4)}", "phone"),
            lambda: ("signed", f"{rnd.choice(first)} {rnd.choice(last)}", "name"), lambda: ("write mail to", f"{rnd.choice(first).lower()} at mail dot org", "email"),
            lambda: ("he lives at", f"{d(2)} {rnd.choice(['Baker', 'Long Hill'])} Street", "address"),
            lambda: ("mail", f"{rnd.choice(first)}{d(2)}@mail.example.com", "email"), lambda: ("call", f"+1 ({d(3)}) 555-{d(4)}", "phone"),
            lambda: ("from server", f"{rnd.randrange(1, 255)}.{rnd.randrange(256)}.{rnd.randrange(256)}.9", "ip")]
    decoy = [lambda: ("order", f"{d(3)}-{d(3)}-{d(4)}", "phone"), lambda: ("invoice", f"{d(4)} {d(3)} {d(3)}", "phone"),
             lambda: ("part", f"{rnd.randrange(100, 600)}-{rnd.randrange(10, 99)}-{d(4)}", "ssn"), lambda: ("total", f"{d(2)}.{d(3)}.{d(4)}.{d(3)}", "ip"),
             lambda: ("serial", f"DE{d(2)}{d(4)}{d(4)}{d(4)}", "iban")]
    filler = "the river runs past an old mill and nobody knew why".split()
    texts, spans = [], []
    for _ in range(docs):
        text, planted = "", set()
        for _ in range(rnd.randrange(1, 6)):
            text += " ".join(rnd.choice(filler) for _ in range(9)) + " "
            is_real = rnd.random() < 0.6
            intro, span, kind = rnd.choice(real if is_real else decoy)()
            text += intro + " "
            if is_real:
                planted.add(f"{kind}:{len(text)}:{len(text) + len(span)}")
            text += span + ", "
        texts.append(text)
        spans.append(planted)
    return texts, spans


def test_added_spans_against_planted(spark):
    texts, planted = made(8, 3000)
    got = personal_data(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA).repartition(8)).collect()
    hit = miss = wrong = 0
    for r in got:
        added = set(filter(None, r.spans.split(","))) - set(brute(texts[r.doc_id]))
        want = planted[r.doc_id] - set(brute(texts[r.doc_id]))
        hit, miss, wrong = hit + len(added & want), miss + len(want - added), wrong + len(added - want)
    assert hit > 2000 and hit / (hit + miss) >= 0.95 and hit / (hit + wrong) >= 0.95, (hit, miss, wrong)


def test_reliabilities_are_found():
    """Votes drawn from labelers of known quality: the estimates come near, the posterior finds the truth."""
    rng = np.random.default_rng(4)
    n, right = 40_000, np.array([0.95, 0.8, 0.7, 0.55])
    truth, kinds = rng.random(n) < 0.3, rng.integers(0, len(KINDS), n)
    votes = np.where(rng.random((n, 4)) < right, truth[:, None], ~truth[:, None]).astype(int) * 2
    votes[rng.random((n, 4)) < 0.2] = 1
    for known in (0.0, 0.1):
        anchors = np.where(rng.random(n) < known, truth * 2, 1)
        found = Reliability(kinds, anchors, votes, np.ones(n))
        said = found.votes[1, :, 2] / (found.votes[1, :, 2] + found.votes[1, :, 0])
        assert np.abs(said - right).max() < 0.06 and np.abs(found.prior - 0.3).max() < 0.08
        assert ((found.posterior(kinds, anchors, votes) > 0.5) == truth).mean() > 0.9


def test_codes_and_classifier():
    codes = np.array([0, 1, int(np.prod(RADIX)) - 1])
    assert (digits_of(codes)[-1] == np.array(RADIX) - 1).all() and digits_of(codes)[1].tolist() == [0] * 9 + [1]
    assert SpanClassifier(codes, np.array([3, 1, 2])).probability(codes).shape == (3,)


def test_empty_and_long(spark):
    assert personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
    for text in ("9" * 2_000_000, "a" * 1_000_000 + "@", "1." * 500_000, "+1" * 300_000, "Ab Cd " * 200_000, "a@" * 300_000, "x@y.de " * 100_000,
                 "(12) 345-6789 " * 50_000, "4111 1111 1111 1111 " * 50_000):
        base, found = spans_of(text)
        assert len(base) in (0, 50_000, 100_000) or text.startswith("1.")
    got = personal_data(spark.createDataFrame([(1, "x@y.de " * 100_000, "", 0)], SCHEMA)).collect()
    assert got[0].n_email == 100_000 and got[0].spans.count(",") == 99_999
