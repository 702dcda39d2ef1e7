"""Repair of the order of turns in conversations.

Every turn is kept, given another role or deleted, and empty turns are
inserted, so that the roles read system (or not), user, assistant, user,
assistant and so on, at the least cost; ``auction`` has the costs and finds
the edits of a run of turns.

``edit_plans`` works without texts: a row brings a digest of its text and what
is wrong with it. A conversation is cut into runs of ``RUN`` turns, so one that
holds a third of all rows is spread: for each run alone an auction gives the
cost between all states at its ends, a scan from the last run to the first adds
up what is still to pay behind each run, and with that a second auction traces
the edits of each run; a scan forwards picks those that fit together. A scan
holds one run at a time. ``repaired`` then passes the texts by once, in order,
beside the letters of their conversation; only there one conversation is in one
task, as its digest runs through its text in order, and nothing of it is held
but the letters.

Edge cases: a null role or text is one space, so such a text is blank. Turns
without a number come first. Rows of one turn stand in the order of role and
of their text's SHA-256; equal rows are repeats of one turn. Rows without a
conversation id are one conversation. A conversation without rows needs no
edits. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import null_safe_join, number_rows
from ..session import cut_lineage
from . import auction
from .batches import small_batches

#: Turns of a run; the work of an auction grows with the square.
RUN = 32

# Fixed values ---------------------------------------------------------------
NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDING = r"[.!?][\x20\x09-\x0D]*\z"
DAMAGES = 20
# ----------------------------------------------------------------------------


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of every row, without nulls in role and text."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _spaced("role").alias("role"), _spaced("text").alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with faults that follow from a checksum of both numbers:
    turns dropped, emptied, without full stops, repeated or said by the user."""
    kind = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))) % DAMAGES
    text = F.when(F.col("_kind") == 1, F.lit("")).when(
        F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")
    ).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    left = rows.select("conv_id", "turn", "role", "text", kind.alias("_kind")).filter("_kind <> 0")
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _facts(rows: DataFrame) -> DataFrame:
    """One row per different turn: who, which text, ``copies`` and ``status`` of the first one.

    The first fault of a turn counts: blank, said before by the same role in
    the conversation, or without an ending. Equal turns are counted where they
    are read; a text's first occurrence is a minimum, taken before shuffling.
    """
    blank = ~F.col("text").rlike(NOT_BLANK)
    first = F.substring("role", 1, 1)
    same = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"),
        F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"),
        blank.alias("blank"), (~blank & ~F.col("text").rlike(ENDING)).alias("cut"),
    ).groupBy("conv_id", "turn", "role", "digest", "initial", "blank", "cut").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = same.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    found = null_safe_join(same, firsts, ["conv_id", "role", "digest"]).withColumn("new", place.eqNullSafe(F.col("first")))
    status = F.when(F.col("blank") | ~F.col("new"), "f").when(F.col("cut"), "t").otherwise("o")
    return found.select("conv_id", "turn", "role", "digest", "initial", "blank", "new", "copies", status.alias("status"))


def _counts(facts: DataFrame) -> DataFrame:
    """``gaps, blank, duplicate, truncated`` per conversation."""
    per_turn = facts.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("copies") - F.col("new").cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((F.col("status") == "t").cast("long")).alias("truncated"),
    )
    known = F.count("turn")
    return per_turn.groupBy("conv_id").agg(
        F.when(known > 0, F.max("turn") - F.min("turn") + 1 - known).otherwise(0).cast("long").alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
    )


def _runs(facts: DataFrame) -> DataFrame:
    """``conv_id, run, runs, turns``: the runs of every conversation as text."""
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    placed = number_rows(
        facts.select("conv_id", "turn", "role", "digest", "initial", "status", "copies"),
        ["conv_id"], order, row="place", total="total",
    )
    run = F.floor((F.col("place") - 1) / RUN).cast("long")
    word = F.concat("initial", "status", F.col("copies").cast("string"))
    return placed.withColumn("run", run).groupBy("conv_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("place", word.alias("word")))).alias("words"),
        F.ceil(F.max("total") / RUN).cast("long").alias("runs"),
    ).select("conv_id", "run", "runs", F.array_join("words.word", " ").alias("turns"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_LONGS, _TEXTS = pa.list_(pa.int64()), pa.list_(pa.string())


def _crossing_costs(batches):
    """``conv_id, run, runs, turns`` with the costs between the states at both ends."""
    schema = pa.schema([("conv_id", pa.int64()), ("run", pa.int64()), ("runs", pa.int64()), ("turns", pa.string()), ("costs", _LONGS)])
    rows = ((i, k, n, t, list(auction.costs(t, k == n - 1))) for i, k, n, t in _rows(batches))
    return _batches(rows, schema)


def _still_to_pay(batches):
    """Runs from last to first: what is to pay behind each run, by state, less the least of it."""
    schema = pa.schema([("conv_id", pa.int64()), ("run", pa.int64()), ("runs", pa.int64()), ("turns", pa.string()), ("exits", _LONGS)])

    def scan():
        behind: list = []
        for conv, k, n, text, matrix in _rows(batches):
            if k == n - 1:
                behind = list(auction.ENDS)
            least = min(x for x in behind if x is not None)
            behind = [None if x is None else x - least for x in behind]
            yield conv, k, n, text, behind
            sums = [[matrix[4 * s + e] + behind[e] for e in range(4) if None not in (matrix[4 * s + e], behind[e])] for s in range(4)]
            behind = [min(x, default=None) for x in sums]

    return _batches(scan(), schema)


def _choices(batches):
    """The best repair of each run for every state at its start."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("run", pa.int64()), ("turns", pa.string()),
        ("costs", _LONGS), ("letters", _TEXTS), ("ends", _LONGS),
    ])

    def choose():
        for conv, k, n, text, exits in _rows(batches):
            entries = (0,) if k == 0 else (0, 1, 2, 3)
            found = auction.repairs(text, tuple(exits), k == n - 1, entries)
            yield conv, k, text, *([x and x[c] for x in found] for c in range(3))

    return _batches(choose(), schema)


_PLAN = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def _joined(batches):
    """Runs from first to last: the repairs that fit together, as one plan per conversation."""

    def scan():
        conv, state, wrong, paid, audit, before = None, None, 0, 0, [], ""
        for i, k, text, cost, letters, ends in _rows(batches):
            if k == 0:
                if state is not None:
                    yield conv, wrong, paid, "".join(audit)
                conv, state, wrong, paid, audit, before = i, auction.START, 0, 0, [], ""
            wrong += auction.illegal(text, before)
            before = text.rpartition(" ")[2][0]
            paid += cost[state]
            audit.append(letters[state])
            state = ends[state]
        if state is not None:
            yield conv, wrong, paid, "".join(audit)

    return _batches(scan(), _PLAN)


def _short(batches):
    """Plans of conversations of one run."""

    def solve():
        for conv, _, _, text in _rows(batches):
            cost, letters, _ = auction.repairs(text)[0]
            yield conv, auction.illegal(text), cost, letters

    return _batches(solve(), _PLAN)


def edit_plans(rows: DataFrame, everyone: DataFrame) -> DataFrame:
    """Per conversation of ``everyone(conv_id)``: counts of faults, the cost and letters of its repair."""
    facts = cut_lineage(_facts(rows), "turns")
    runs = cut_lineage(_runs(facts), "runs")
    plan = "conv_id long, illegal long, cost long, audit string"
    plans = runs.filter("runs = 1").mapInArrow(_short, plan)
    many = runs.filter("runs > 1")
    if not many.isEmpty():
        several = "conv_id long, run long, runs long, turns string"
        costs = many.repartition("conv_id", "run").mapInArrow(_crossing_costs, f"{several}, costs array<long>")
        costs = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("run"))
        exits = costs.mapInArrow(_still_to_pay, f"{several}, exits array<long>").repartition("conv_id", "run")
        choices = exits.mapInArrow(
            _choices, "conv_id long, run long, turns string, costs array<long>, letters array<string>, ends array<long>"
        )
        ordered = choices.repartition("conv_id").sortWithinPartitions("conv_id", "run")
        plans = plans.unionByName(ordered.mapInArrow(_joined, plan))
    found = null_safe_join(_counts(facts), plans, ["conv_id"])
    found = null_safe_join(everyone.select("conv_id").distinct(), found.withColumn("of", F.col("conv_id")), ["conv_id"], "left")
    zeros = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    return found.drop("of").fillna(zeros).fillna("", ["audit"])


_TURN = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


class _Editor:
    """Applies the letters of one conversation to its turns, one by one."""

    def __init__(self, conv, letters: str):
        self.conv, self.letters, self.at, self.state, self.place = conv, letters, 0, auction.START, 0

    def _out(self, edit: str, role: str, text: str) -> tuple:
        self.place += 1
        return self.conv, self.place - 1, edit, role, text

    def inserts(self) -> Iterator[tuple]:
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = auction.NEXT[self.state]
            yield self._out("I", auction.ROLES[self.state], "")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = auction.KEEPS[self.state, role[0]]
            yield self._out("K", role, text)
        elif letter == "R":
            self.state = auction.NEXT[self.state]
            yield self._out("R", auction.ROLES[self.state], text)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the turns after their edits.

    The turns of a conversation stand in one partition, in order. Letters and
    texts meet in one shuffle; a conversation's letters come before its turns.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    heads = plans.select(
        "conv_id", F.lit(0).alias("kind"), nothing("long").alias("turn"), nothing("string").alias("role"),
        nothing("string").alias("digest"), F.col("audit").alias("text"),
    )
    lines = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.sha2("text", 256).alias("digest"), "text")
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    met = small_batches(heads.unionByName(lines).repartition("conv_id").sortWithinPartitions(*order))

    def run(batches):
        editor = None
        for batch in batches:
            done: list[tuple] = []
            for conv, kind, role, text in _rows(iter([batch])):
                if kind == 0:
                    if editor:
                        done += editor.inserts()
                    editor = _Editor(conv, text)
                else:
                    done += editor.turn(role, text)
            yield from _batches(iter(done), _TURN)
        if editor:
            yield from _batches(editor.inserts(), _TURN)

    return met.select("conv_id", "kind", "role", "text").mapInArrow(
        run, "conv_id long, place long, edit string, role string, text string"
    )


def digests(turns_in_order: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: digest of the lines ``role:text`` of what ``repaired`` gives, as it comes."""

    def run(batches):
        def scan():
            conv, state = None, None
            for i, place, role, text in _rows(batches):
                if place == 0:
                    if state:
                        yield conv, state.hexdigest()
                    conv, state = i, hashlib.sha256()
                state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if state:
                yield conv, state.hexdigest()

        yield from _batches(scan(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    return turns_in_order.select("conv_id", "place", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")
