import hashlib
import random
import re
import zlib
from functools import lru_cache

import pyarrow.parquet as pq

from corpuscope.llm.conversation_repair import repair_conversations
from corpuscope.llm.queries_repair import damaged

SCHEMA = "conv_id long, turn long, role string, text string, KIND int, at string"
EMPTY = hashlib.sha256(b"").hexdigest()


def damage(rows):
    out, ids = [], []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text = show(role), show(text)
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        ids.append(conv)
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out, ids


def brute(rows):
    """Shortest edits of one conversation's (turn, role, text), by trying every edit at every place."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        stripped = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen
                      else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, so_far, inserts):
        """(cost, audit, lines) from row i on; so_far: the initials written, whole conversation folded to its last two."""
        options = []
        if i == len(rows) and so_far in ("", "ua"):
            options.append((0, "", ()))
        grow = lambda c: {"": c if c in "su" else None, "s": "u" if c == "u" else None, "u": "ua" if c == "a" else None,
                          "ua": "u" if c == "u" else None}[so_far] if c in ("s", "u", "a") else None

        def then(cost, letter, lines, state, j, ins):
            rest = best(j, state, ins)
            if rest is not None:
                options.append((cost + rest[0], letter + rest[1], lines + rest[2]))
        if inserts < 3:
            for role in ("user", "assistant"):
                if grow(role[0]):
                    then(3, "I", (role + ":",), grow(role[0]), i, inserts + 1)
        if i < len(rows):
            _, role, text = rows[i]
            then(4, "D", (), so_far, i + 1, 0)
            if faults[i] in ("", "truncated"):
                more = 3 if faults[i] else 0
                if grow(role[:1]):
                    then(more, "K", (role + ":" + text,), grow(role[:1]), i + 1, 0)
                for new in ("user", "assistant"):
                    if grow(new[0]):
                        then(3 + more, "R", (new + ":" + text,), grow(new[0]), i + 1, 0)
        return min(options, default=None)

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def wanted(rows, ids):
    groups = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role, text))
    return {conv: brute(g) for conv, g in groups.items()}


def as_dict(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, conversations, longest):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "", "  ", "Why?", "So it is!  ", "Fine. \t\n", "a.b", "é…", "..."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", "unknown", None]
    rows = []
    for conv in range(conversations):
        turn = 0
        for _ in range(rnd.randrange(0, longest)):
            rows.append((rnd.choice([conv, conv, conv, None]) if conv == 0 else conv,
                         None if rnd.random() < 0.1 else turn, rnd.choice(roles),
                         None if rnd.random() < 0.05 else rnd.choice(texts)))
            turn += rnd.choice([0, 1, 1, 1, 2, 5])
    return rows + rows[:3]


def test_against_every_edit(spark):
    rows = made(1, 150, 12)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert as_dict(repair_conversations(frame)) == wanted(plain, [])
    assert as_dict(repair_conversations(frame, spill_rows=2)) == wanted(plain, [])  # back pointers as blocks


def test_damaged_documents(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    rows = [tuple(r.values()) for r in pq.read_table(path, columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    rows += [(-1, 3, "user", "Only."), (-1, None, None, None), (None, None, "user", None)]
    frame = damaged(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    got = as_dict(repair_conversations(frame.where("code <> 0"), frame.where("code = 0").select("conv_id")))
    assert got == wanted(*damage(rows))


def test_nothing_left(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(empty).collect() == []
    ids = spark.createDataFrame([(7,), (7,), (None,)], "conv_id long")
    assert as_dict(repair_conversations(empty, ids)) == {i: (0, 0, 0, 0, 0, 0, "", EMPTY) for i in (7, None)}


def test_one_long_conversation(spark):
    n = 30_000
    rows = [(5, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.", 0, "") for i in range(n)]
    rows[100] = (5, 100, "assistant", "Turn 100.", 0, "")
    rows[200] = (5, 200, "user", "Turn 4.", 0, "")
    got = as_dict(repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(8), spill_rows=1000))[5]
    audit = "K" * 100 + "R" + "K" * 99 + "DI" + "K" * (n - 201)
    lines = [f"{r[2]}:{r[3]}" for r in rows]
    lines[100], lines[200] = "user:Turn 100.", "user:"
    assert got == (0, 0, 1, 0, 2, 10, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_long_text(spark):
    text = "word " * 400_000
    got = as_dict(repair_conversations(spark.createDataFrame([(1, 0, "user", text, 0, ""), (1, 1, "assistant", "Yes.", 0, "")], SCHEMA)))
    assert got[1][:7] == (0, 0, 0, 1, 0, 3, "KK")
    assert got[1][7] == hashlib.sha256(f"user:{text}\nassistant:Yes.".encode()).hexdigest()
