"""Operator 11: repair the turn order of conversations at the least cost.

A conversation is legal when the initials of its roles read ``s?(ua)+`` or when
it is empty.  Edits, in audit letters:

``D`` delete a row (4; a blank or repeated row must be deleted),
``I`` insert a row with empty text (3), ``K`` keep a row (0),
``R`` give a row the role user or assistant (3);
a truncated row that is not deleted adds 3.

Of the cheapest edit sequences the one that is least in ASCII order is taken.

Secondary-sorted streaming: the rows are dealt by conversation and sorted by
turn; one pass of ``mapInPandas`` carries, from Arrow batch to Arrow batch, the
cheapest way into each of the four states of the legal order together with its
running SHA-256, so a conversation of any length needs one row of texts at a
time.  Every row leaves four bytes of back pointers.  Those of a conversation of
more than ``spill_rows`` rows leave the task as blocks of a written table, which
a second pass reads backwards, again carrying one state only.

The repaired text is hashed from its first byte to its last, so the rows of one
conversation pass through one task; that task holds no group, and all work per
row that needs no order (damage, faults, digests, first occurrences) is done by
Spark before the rows are dealt.  First occurrences are a partial ``min``
aggregate per (conversation, role, text digest), sent along as marker rows.

Defined results: a null role or text reads as one space, so it cannot be kept
under its role, or is blank; rows without a turn come first; rows that tie on the
turn are ordered by role, then by the digest of the text, and equal rows stand
together; a null conversation id is a conversation of its own; other columns are
ignored; an empty table gives an empty result; long texts pass whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize

#: Costs of the edits, sentence ends and white space.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SENTENCE_ENDS = ".!?"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: The states nothing, system, user, assistant; where a kept role leads; the role that may come next.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL_PAIRS = {"su", "ua", "au"}
ROLE_NAMES = {USER: b"user:", ASSISTANT: b"assistant:"}

#: Faults of a row, the first that holds.
SOUND, CUT, REPEATED, BLANK = range(4)
#: Rows whose back pointers a task keeps in memory, four bytes each, before it sends them off as a block.
SPILL_ROWS = 1 << 18

#: What one row may do: inserts before it and the edit of the row itself, as audit letters.
PIECES = ["I" * n + edit for n in range(3) for edit in "DKR"]
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

STEPS = ("conv {id}, conv_null boolean, block long, pointers binary, final_state int, gaps long, blank long, "
         "duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def moves(initial: str, fault: int) -> list[list[tuple[int, int, int]]]:
    """For each state after a row: (state before, cost, piece), the best piece per state before."""
    best: list[dict[int, tuple[int, str]]] = [{} for _ in range(4)]
    for before in range(4):
        for piece in PIECES:
            state, cost = before, INSERT * (len(piece) - 1)
            for _ in piece[:-1]:
                state = NEXT[state]
            edit = piece[-1]
            if edit == "D":
                cost += DELETE
            elif fault in (BLANK, REPEATED) or (edit == "K" and initial not in KEPT[state]):
                continue
            else:
                cost += (TRUNCATED if fault == CUT else 0) + (REROLE if edit == "R" else 0)
                state = KEPT[state][initial] if edit == "K" else NEXT[state]
            if before not in best[state] or (cost, piece) < best[state][before]:
                best[state][before] = (cost, piece)
    return [[(before, cost, PIECES.index(piece)) for before, (cost, piece) in sorted(b.items())] for b in best]


class Conversation:
    """The running state of one conversation: at each state the cost, the order among
    the edit strings of equal cost, and the hash of the repaired text so far.

    Strings of different states at the same row end in that row's edit, so none is
    the beginning of another and their order never changes by what follows.
    """

    def __init__(self):
        self.cost = {START: 0}
        self.rank = {START: 0}
        self.sha = {START: hashlib.sha256()}
        self.pointers = bytearray()
        self.blocks = 0
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, table, turn, role: str, text: bytes, initial: str, fault: int) -> None:
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            if turn != self.last_turn:
                self.turns += 1
            self.last_turn = turn
        self.blank += fault == BLANK
        self.duplicate += fault == REPEATED
        self.truncated += fault == CUT
        if self.before is not None and self.before + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.before = initial

        cost, rank, sha, found = self.cost, self.rank, self.sha, []
        for after, ways in enumerate(table):
            choice = min(((cost[b] + c, rank[b], p, b) for b, c, p in ways if b in cost), default=None)
            if choice is None:
                self.pointers.append(255)
            else:
                found.append((choice[1], PIECES[choice[2]], after, choice))
                self.pointers.append(choice[3] * len(PIECES) + choice[2])
        self.cost, self.rank, self.sha = {}, {}, {}
        for place, (_, piece, after, (total, _, _, state)) in enumerate(sorted(found)):
            self.cost[after], self.rank[after] = total, place
            self.sha[after] = self._hashed(sha[state], state, piece, role, text)

    @staticmethod
    def _hashed(sha, state: int, piece: str, role: str, text: bytes):
        if piece == "D":
            return sha
        sha = sha.copy()
        for letter in piece:
            if letter == "D":
                continue
            if state != START:
                sha.update(b"\n")
            if letter == "K":
                sha.update(role.encode("utf-8", "surrogatepass") + b":")
                sha.update(text)
            else:
                state = NEXT[state]
                sha.update(ROLE_NAMES[state])
                if letter == "R":
                    sha.update(text)
        return sha

    def block(self) -> bytes:
        out = bytes(self.pointers)
        self.pointers.clear()
        self.blocks += 1
        return out

    def result(self) -> tuple:
        """(final state, gaps, blank, duplicate, truncated, illegal, cost, audit or None, hash)."""
        ends = [(c + INSERT * len(TAILS[s]), self.rank[s], s) for s, c in self.cost.items()]
        cost, _, state = min(ends)
        sha = self._hashed(self.sha[state], state, TAILS[state], "", b"").hexdigest()
        audit = None if self.blocks else trace(self.pointers, state)[0] + TAILS[state]
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return state, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, sha


def trace(pointers: bytes, state: int) -> tuple[str, int]:
    """The audit letters of a run of rows that ends in ``state``, and the state before it."""
    out = []
    for at in range(len(pointers) - 4, -1, -4):
        state, piece = divmod(pointers[at + state], len(PIECES))
        out.append(PIECES[piece])
    return "".join(reversed(out)), state


def _stream(spill_rows: int):
    columns = [part.split()[0] for part in STEPS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[tuple[str, int], list] = {}
        key, talk, marked, out = None, None, None, []

        def finish():
            if talk.blocks and talk.pointers:
                out.append((*key, talk.blocks, talk.block(), *[None] * 9))
            out.append((*key, None, None, *talk.result()))

        def frame():
            done = pd.DataFrame(out, columns=columns)
            for c in columns[2:-2]:
                if c != "pointers":
                    done[c] = done[c].astype("Int64")
            out.clear()
            return done

        for batch in batches:
            for conv, conv_null, kind, turn, turn_null, role, digest, text, fault in zip(
                    *[batch[c].tolist() for c in ("conv", "conv_null", "kind", "at", "at_null", "role", "digest", "text", "fault")]):
                if key != (conv, conv_null):
                    if key is not None:
                        finish()
                    key, talk, marked = (conv, conv_null), Conversation(), None
                if kind == 0:
                    continue
                if kind == 1:
                    marked = (turn, turn_null, role, digest)
                    continue
                if fault != BLANK and marked != (turn, turn_null, role, digest):
                    fault = REPEATED
                marked = None
                initial = role[:1]
                table = tables.get((initial, fault))
                if table is None:
                    # all other initials act alike
                    table = tables[initial, fault] = moves(initial if initial in ("s", "u", "a") else "", fault)
                    if len(tables) > 10_000:
                        tables = {}
                talk.add(table, None if turn_null else turn, role, text, initial, fault)
                if len(talk.pointers) >= 4 * spill_rows:
                    out.append((*key, talk.blocks, talk.block(), *[None] * 9))
            if out:
                yield frame()
        if key is not None:
            finish()
            yield frame()
    return run


def _walk_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of one conversation from the last to the first; ``final_state`` stands on each."""
    key, state = None, None
    for batch in batches:
        out = []
        for conv, conv_null, block, pointers, final in zip(
                *[batch[c].tolist() for c in ("conv", "conv_null", "block", "pointers", "final_state")]):
            if key != (conv, conv_null):
                key, state = (conv, conv_null), final
            letters, state = trace(pointers, state)
            out.append((conv, conv_null, block, letters))
        yield pd.DataFrame(out, columns=["conv", "conv_null", "block", "letters"])


def faults(text: str | Column) -> Column:
    """``BLANK``, ``CUT`` or ``SOUND``; repeats are found later."""
    end = F.rtrim(F.col(text) if isinstance(text, str) else text, F.lit(SPACE_CHARS))
    return (F.when(end == "", F.lit(BLANK)).when(F.contains(F.lit(SENTENCE_ENDS), F.substring(end, -1, 1)), F.lit(SOUND))
            .otherwise(F.lit(CUT)))


def repair_conversations(rows: DataFrame, announced: DataFrame | None = None, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text) and of ``announced`` (conv_id).

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit,
    repaired_sha256.  ``announced`` names conversations that are to be returned even
    when no row of them is left; ids may repeat in it.  Writes one table below the
    shared checkpoint folder.
    """
    spark = rows.sparkSession
    id_type = rows.schema["conv_id"].dataType.simpleString()
    nothing = F.lit("0").cast(id_type)
    conv = [F.coalesce(F.col("conv_id"), nothing).alias("conv"), F.col("conv_id").isNull().alias("conv_null")]
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    turns = rows.select(*conv, F.lit(2).alias("kind"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
                        F.col("turn").isNull().alias("at_null"), role.alias("role"),
                        F.unhex(F.sha2(text, 256)).alias("digest"), F.encode(text, "UTF-8").alias("text"),
                        faults(text).alias("fault"))
    first = turns.groupBy("conv", "conv_null", "role", "digest").agg(
        F.min(F.struct((~F.col("at_null")).alias("has"), "at")).alias("first"))
    markers = first.select("conv", "conv_null", F.lit(1).alias("kind"), F.col("first.at").alias("at"),
                           (~F.col("first.has")).alias("at_null"), "role", "digest", F.lit(b"").alias("text"),
                           F.lit(SOUND).alias("fault"))
    stream = turns.unionByName(markers)
    if announced is not None:
        stream = stream.unionByName(announced.select(
            *conv, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("at_null"),
            F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(b"").alias("text"), F.lit(SOUND).alias("fault")))
    dealt = (stream.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv", "conv_null")
             .sortWithinPartitions("conv_null", "conv", F.desc("at_null"), "at", "role", "digest", "kind"))
    steps = materialize(dealt.mapInPandas(_stream(spill_rows), STEPS.format(id=id_type)), "conversation-steps")

    done = steps.where("block is null")
    blocks = steps.where("block is not null").select("conv", "conv_null", "block", "pointers")
    finals = done.where("audit is null").select("conv", "conv_null", "final_state")
    back = (blocks.join(finals, ["conv", "conv_null"]).repartition("conv", "conv_null")
            .sortWithinPartitions("conv_null", "conv", F.desc("block")))
    letters = back.mapInPandas(_walk_back, f"conv {id_type}, conv_null boolean, block long, letters string")
    audits = letters.groupBy("conv", "conv_null").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda b: b["letters"]), "").alias("long_audit"))
    tail = F.element_at(F.array(*[F.lit(TAILS[s]) for s in range(4)]), F.col("final_state") + 1)
    return done.join(audits, ["conv", "conv_null"], "left").select(
        F.when(~F.col("conv_null"), F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated",
        "illegal", "cost", F.coalesce("audit", F.concat("long_audit", tail)).alias("audit"), "repaired_sha256")
