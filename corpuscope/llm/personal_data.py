"""Operator 12: personal data by weak supervision.

Spans of four kinds are fixed by rules (``BASE_KINDS``) and always returned.  Beside
them the texts are searched for looser candidates: further ways to write those
kinds, and IBANs, social security numbers, names and street addresses.  Five
labelers vote yes, no or nothing on every candidate:

``rule``      the strict pattern and its checksum; a candidate that fails it is never returned
``gazetteer`` top-level domains, dialling codes, card issuers, countries, first names, street words
``context``   words of the 48 characters before the span
``edges``     no, when the span is part of a longer token
``layout``    grouping of digits, capitals and separators usual for the kind

Spark counts the vote patterns of the whole corpus.  Expectation-maximisation
(Dawid and Skene) on these counts estimates how reliable each labeler is and how
often each kind is real, without labels; only the yes and no of the rule are certain.  The posteriors then train a logistic
regression on features of the span that no labeler sees as such (kind, digits,
characters at its sides, hash of the word before), and the regression decides.

Texts are scanned once, in Arrow batches; the scan is linear in the text whatever
it holds.  The table of candidates is written and read again.  What reaches the
driver is one row per distinct (votes, features) code, at most ``CODES``.

Defined results: a null text is empty; positions are code points; a table without
candidates gives base spans only (none); rows are judged one by one, so equal ids
and equal rows each have their result; other columns are ignored; ties of spans go
to the earlier kind of ``KINDS``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn", "name", "address")
LABELERS = ("rule", "gazetteer", "context", "edges", "layout")

#: The base patterns.  Possessive runs and look-behinds give the same matches in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Looser forms.
AT = re.compile(r"\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?", re.I)
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}", re.I)
LOCAL_PHONE = re.compile(r"(?<![\w+(.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![\w-]|\.[0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
NAME = re.compile(r"(?<!\w)[A-Z][a-zà-öø-ÿ]{1,20}(?:\x20[A-Z][a-zà-öø-ÿ]{1,20}){1,2}(?!\w)")
ADDRESS = re.compile(r"(?<!\w)[0-9]{1,5}\x20(?:[A-Z][a-zà-ÿ]{1,20}\x20){1,3}[A-Z][a-z]{1,10}(?!\w)")

#: Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io eu de fr es uk us ca au ch at it nl be pl se no fi dk ru cn jp in br mx ar".split())
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
              "52", "54", "55", "61", "64", "81", "82", "86", "90", "91", "351", "352", "353", "358", "420")
COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split())
FIRST_NAMES = frozenset("""Adam Alice Ana Andrew Anna Antonio Carlos Carmen Charles Claire David Elena Elizabeth Emily Emma Eva
    Francisco George Hans Hannah Heinz Isabel James Jane Javier Jean Jennifer John Jose Juan Julia Karl Klaus Laura Linda Louis Luis
    Marc Maria Marie Mary Michael Michel Miguel Nicolas Olivia Patricia Paul Peter Pierre Richard Robert Sarah Sophie Stefan
    Susan Thomas Ursula William Wolfgang""".split())
STREET_WORDS = frozenset("Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Square Court Ct Way Terrace Place".split())
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame senor senora señor señora".split())
#: Words of the context that speak for a kind, and those that speak against all.
FOR = {
    "email": frozenset("mail email e-mail contact write courriel correo schreiben".split()),
    "ip": frozenset("ip host server address client from login connected adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta payment".split()),
    "phone": frozenset("call phone tel telephone mobile cell fax dial ring contact telefon téléphone teléfono handy".split()),
    "iban": frozenset("iban account bank transfer konto compte cuenta".split()),
    "ssn": frozenset("ssn social security".split()),
    "name": TITLES | frozenset("name called nom nombre heiße signed sincerely regards author patient".split()),
    "address": frozenset("address live lives living street ship deliver home adresse wohnt dirección".split()),
}
AGAINST = frozenset("version release build isbn issn order invoice page pages serial model part total price sum chapter figure table "
                    "section article item sku ticket case room level score ratio".split())
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
CONTEXT = 48

#: Sizes of a code's digits: kind, five votes, digits, side before, side after, word before.
DIGIT_STEPS = (0, 5, 9, 12, 16)
SIDES = 4
WORD_SLOTS = 8
RADIX = (len(KINDS), 3, 3, 3, 3, 3, len(DIGIT_STEPS) + 1, SIDES, SIDES, WORD_SLOTS)
CODES = int(np.prod(RADIX))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str):
    """Leftmost matches of the e-mail pattern, found from each ``@`` outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def strict_spans(text: str):
    """(kind, start, end, valid): matches of the base patterns, with their checks."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end, True
    for m in QUAD.finditer(text):
        yield "ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
    for m in DIGITS.finditer(text):
        digits = only_digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 20:
            yield "card", *m.span(), 13 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in PLUS.finditer(text):
            n = sum(c in "0123456789" for c in m[0])
            yield "phone", *m.span(), 9 <= n <= 15


def iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    moved = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def loose_spans(text: str):
    """(kind, start, end, vote of the rule) of the looser forms, kinds in the order of preference."""
    for m in IBAN.finditer(text):
        yield "iban", *m.span(), 1 if iban_valid(m[0]) else -1
    for m in SSN.finditer(text):
        yield "ssn", *m.span(), -1 if m[0][:3] in ("000", "666") or m[0][0] == "9" or m[0][4:6] == "00" or m[0][7:] == "0000" else 0
    for m in AT.finditer(text):
        before = BEFORE_AT.search(text[max(0, m.start() - 64):m.start()])
        after = AFTER_AT.match(text, m.end())
        if before and after:
            yield "email", m.start() - len(before[0]), after.end(), 0
    for m in LOCAL_PHONE.finditer(text):
        n = len(only_digits(m[0]))
        yield "phone", *m.span(), 0 if 9 <= n <= 12 else -1
    for m in ADDRESS.finditer(text):
        if m[0].rsplit(" ", 1)[1] in STREET_WORDS:
            yield "address", *m.span(), 0
    for m in NAME.finditer(text):
        title = WORD.findall(text[max(0, m.start() - 12):m.start()])[-1:]
        first = m[0].split(" ")[0]
        if first in FIRST_NAMES or first.lower() in TITLES or (title and title[0].lower() in TITLES):
            yield "name", *m.span(), 0


def gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        last = re.split(r"[.\x20\])]+", span.lower())[-1]
        return 1 if last in TOP_DOMAINS else 0
    if kind == "ip":
        parts = span.split(".")
        return -1 if parts[0].lstrip("0") in ("", "127") or len(set(parts)) == 1 else 0
    if kind == "card":
        d = only_digits(span)
        issued = d[0] == "4" or "51" <= d[:2] <= "55" or "2221" <= d[:4] <= "2720" or d[:2] in ("34", "37", "65") or d[:4] == "6011"
        return 1 if issued else -1
    if kind == "phone":
        return (1 if only_digits(span).startswith(DIAL_CODES) else -1) if span[0] == "+" else 0
    if kind == "iban":
        return 1 if span[:2] in COUNTRIES else -1
    if kind == "name":
        return 1 if span.split(" ")[0] in FIRST_NAMES else 0
    return 1 if kind == "address" else 0


def layout(kind: str, span: str) -> int:
    if kind == "card":
        groups = [len(g) for g in re.split(r"[\x20-]", span)]
        return 1 if groups in ([16], [4, 4, 4, 4], [4, 6, 5], [15]) else -1 if 1 in groups else 0
    if kind == "phone":
        return 1 if span[0] == "+" and re.search(r"[\x20().-]", span) else 0
    if kind == "email":
        return -1 if ".." in span or span[0] in ".%+-" else 1 if "@" in span else 0
    if kind == "ip":
        return -1 if re.search(r"(?:^|\.)0[0-9]", span) else 1
    return 0


def side(char: str) -> int:
    return 0 if char == "" or char.isspace() else 1 if char.isalnum() or char == "_" else 2 if char in ".,;:!?)]}\"'" else 3


def code_of(text: str, kind: str, start: int, end: int, rule: int) -> int:
    """Votes and features of a span as one number below ``CODES``."""
    span, left = text[start:end], text[max(0, start - CONTEXT):start]
    words = [w.lower() for w in WORD.findall(left)]
    before, after = text[start - 1:start], text[end:end + 1]
    context = -1 if AGAINST.intersection(words[-3:]) else 1 if FOR[kind].intersection(words) else 0
    edges = -1 if side(before) == 1 or side(after) == 1 else 0
    digits = sum(c in "0123456789" for c in span[:64])
    values = (KINDS.index(kind), rule + 1, gazetteer(kind, span) + 1, context + 1, edges + 1, layout(kind, span) + 1,
              sum(digits >= s for s in DIGIT_STEPS), side(before), side(after),
              crc32(words[-1].encode()) % (WORD_SLOTS - 1) + 1 if words else 0)
    code = 0
    for size, v in zip(RADIX, values):
        code = code * size + v
    return code


def spans_of(text: str):
    """(kind number, start, end, base, code) of a text's base spans and candidates.

    Failed matches of the base patterns are kept as candidates with a no of the rule:
    they tell the training what is not personal data.
    """
    base, out, taken = [], [], []
    for kind, start, end, valid in strict_spans(text):
        if valid:
            base.append((kind, start, end))
        out.append((KINDS.index(kind), start, end, valid, code_of(text, kind, start, end, 1 if valid else -1)))
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    free = 0  # leftmost candidates first; at one place the earlier kind of loose_spans
    for kind, start, end, rule in sorted(loose_spans(text), key=lambda c: c[1]):
        i = bisect_left(starts, end)
        if start < free or (i and reach[i - 1] > start):
            continue
        if rule >= 0:
            free = end
        out.append((KINDS.index(kind), start, end, False, code_of(text, kind, start, end, rule)))
    return base, out


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("code", pa.int32())])
FOUND = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
         "found array<struct<kind: int, start: long, end: long, base: boolean, code: int>>")


def _scan(batches):
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        counts, digests, found = [], [], []
        for text in batch.column(1).to_pylist():
            base, spans = spans_of(text or "")
            counts.append([sum(k == kind for k, _, _ in base) for kind in BASE_KINDS] if base else (0, 0, 0, 0))
            base.sort(key=lambda b: (KINDS.index(b[0]), b[1]))
            digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest() if base else nothing)
            found.append([dict(zip(("kind", "start", "end", "base", "code"), s)) for s in spans])
        longs = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *longs, pa.array(digests, pa.string()), pa.array(found, pa.list_(SPAN))],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"])


def candidates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, and all spans with their codes."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {id_type}, {FOUND}")


def digits_of(codes: np.ndarray) -> np.ndarray:
    """The digits of each code, one column per entry of ``RADIX``."""
    out, rest = [], codes.astype(np.int64)
    for size in reversed(RADIX):
        out.append(rest % size)
        rest = rest // size
    return np.stack(out[::-1], axis=1)


class Reliability:
    """What expectation-maximisation finds: ``prior[kind]`` and ``votes[label, labeler, vote]``.

    ``anchors`` holds the votes of the rule (0 no, 1 nothing, 2 yes): its yes and no are certain,
    the other labelers are measured against them and against each other.
    """

    #: Votes (no, nothing, yes) seen beforehand, as so many candidates: labelers are better than chance.
    BELIEF = np.array([[5.0, 4.0, 1.0], [1.0, 4.0, 5.0]])
    #: Real and other candidates seen beforehand of each kind: without a vote a candidate is none.
    BELIEVED = (3.0, 7.0)

    def __init__(self, kinds: np.ndarray, anchors: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 60):
        n_kinds, n_labelers = len(KINDS), votes.shape[1]
        self.prior = np.full(n_kinds, self.BELIEVED[0] / sum(self.BELIEVED))
        believed = self.BELIEF / self.BELIEF.sum(1, keepdims=True)
        self.votes = np.repeat(believed[:, None, :], n_labelers, axis=1)
        for _ in range(rounds):
            p = self.posterior(kinds, anchors, votes)
            for label, share in ((0, counts * (1 - p)), (1, counts * p)):
                for j in range(n_labelers):
                    seen = np.bincount(votes[:, j], weights=share, minlength=3) + self.BELIEF[label]
                    self.votes[label, j] = seen / seen.sum()
            open_ = anchors == 1  # how often a kind is real matters where the rule says nothing
            real = np.bincount(kinds, weights=counts * p * open_, minlength=n_kinds)
            total = np.bincount(kinds, weights=counts * open_, minlength=n_kinds)
            self.prior = (real + self.BELIEVED[0]) / (total + sum(self.BELIEVED))

    def posterior(self, kinds: np.ndarray, anchors: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """Probability that a candidate is personal data, given its kind and votes."""
        odds = np.log(self.prior[kinds]) - np.log1p(-self.prior[kinds])
        for j in range(votes.shape[1]):
            odds = odds + np.log(self.votes[1, j, votes[:, j]]) - np.log(self.votes[0, j, votes[:, j]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return np.where(anchors == 1, p, anchors / 2)


class SpanClassifier:
    """Logistic regression on kind, kind with the digits, the sides and the word before, fitted to soft labels."""

    RIDGE = 1.0

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 60):
        digits = digits_of(codes)
        seen = digits[:, 0], digits[:, 1], digits[:, 2:6]
        self.reliability = Reliability(*seen, counts.astype(float))
        target = self.reliability.posterior(*seen)
        x, w = self._features(digits), np.zeros(self.size())
        for _ in range(rounds):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (counts * (p - target)) + self.RIDGE * w
            bend = (x * (counts * p * (1 - p))[:, None]).T @ x + self.RIDGE * np.eye(len(w))
            step = np.linalg.solve(bend, slope)
            w = w - step / max(1.0, float(np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    @staticmethod
    def size() -> int:
        return len(KINDS) * (1 + 3 * 3) + RADIX[6] + 2 * SIDES + WORD_SLOTS

    @staticmethod
    def _features(digits: np.ndarray) -> np.ndarray:
        rows, x, at = np.arange(len(digits)), np.zeros((len(digits), SpanClassifier.size())), 0
        x[rows, digits[:, 0]] = 1
        at += len(KINDS)
        for column in (2, 3, 5):  # what the gazetteer, the context and the layout saw, per kind
            x[rows, at + digits[:, 0] * 3 + digits[:, column]] = 1
            at += 3 * len(KINDS)
        for column in (6, 7, 8, 9):
            x[rows, at + digits[:, column]] = 1
            at += RADIX[column]
        return x

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._features(digits_of(codes)) @ self.weights, -30, 30)))


def code_counts(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each code occurs in the whole table: at most ``CODES`` rows."""
    table = (found.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
             .orderBy("code").toArrow())
    return table["code"].to_numpy(), table["n"].to_numpy()


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` holds the base spans and the candidates that the trained classifier gives
    ``threshold`` or more, as kind:start:end.  Writes one table and runs two jobs at once.
    """
    found = materialize(candidates(docs), "personal-data")
    codes, counts = code_counts(found)
    accepted: list[int] = []
    if len(codes):
        p = SpanClassifier(codes, counts).probability(codes)
        accepted = [int(c) for c in codes[(p >= threshold) & (digits_of(codes)[:, 1] > 0)]]
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter("found", lambda s: s["base"] | (s["code"].isin(accepted) if accepted else F.lit(False)))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    spans = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))
