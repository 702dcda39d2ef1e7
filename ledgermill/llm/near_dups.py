"""Near duplicates by bottom-k sketches of word shingles.

One hash function orders all shingles. A document keeps its ``SKETCH`` smallest
values. Inverted lists of the retained values bring documents together, the
sketch of a pair's union estimates its similarity, and the full sets decide.

No list is turned into all its pairs. Documents with equal sets are one node
from the start. Each node is first tested against one pivot of its lists, and
lists whose members have come into one component are done. Nodes left in open
lists meet again in lists of all their shingles, less those that no other
component holds. There they are tested against ``PIVOTS`` pivots of each list,
and then so many times more per round, until every member of an open list has
been a pivot: no pair of a list stays untested unless a chain of links already
joins it or the sizes rule it out, so the components are those of all links.

A document enters only the lists of its rarest retained values. Two documents
at the threshold share at least ``shared_at_least`` retained values, so they
meet in the lists of their ``size - shared_at_least + 1`` rarest ones. For
sets of up to ``threshold * SKETCH`` shingles that bound is exact. For larger
ones the shared values of the union's sketch follow a hypergeometric law with
mean ``threshold * SKETCH``; the bound lies ``DEVIATIONS`` standard deviations
below, which a linked pair misses with a chance below 1e-8.

Edge cases: a null or empty text, or one without words, has an empty set, is
linked with nothing and is kept. A row without an id is linked with nothing,
has a null component and is kept. Rows of one id are one document: what links
any of its texts links the id. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import small_batches
from .components import components
from .words import BLANK_WORDS, Words, mix, shingles, text_slices

SKETCH = 64
THRESHOLD = 80  # percent
WIDTH = 5
DEVIATIONS = 6
#: Pivots of an open list of shingles; each later round has so many times more.
PIVOTS = 64
#: Members of a list that one task holds against its pivots.
LIST_ROWS = 256
#: Classes of values whose parities tell most dissimilar sets apart.
PARITIES = 1024
#: Ratio of the sizes at the ends of a band.
BAND = 1.05

KEY = ["v", "low", "high"]
_SIGN = np.uint64(1 << 63)


def shared_at_least(size: int, threshold: int = THRESHOLD, sketch: int = SKETCH) -> int:
    """Retained values that a linked partner shares with a set of ``size`` shingles."""
    j = threshold / 100
    if size <= j * sketch:
        return -(-threshold * size // 100)
    spread = math.sqrt(sketch * j * (1 - j))
    return max(1, math.floor(j * sketch - DEVIATIONS * spread))


def _signed(values: np.ndarray) -> np.ndarray:
    """64-bit values as longs in the same order."""
    return (values ^ _SIGN).view(np.int64)


def _parity(values: np.ndarray) -> np.ndarray:
    """Whether the number of a set's values is odd in each of ``PARITIES`` classes, as bits of longs."""
    classes = (mix(values) >> np.uint64(64 - int(PARITIES).bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(classes, minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


def _row_sets(batches, width: int):
    """Per slice: the slice and the sorted distinct shingles of each of its rows."""
    for part in text_slices(batches):
        hashes, first = shingles(Words(part.column("text"), BLANK_WORDS), width)
        yield part, [np.unique(hashes[first[i] : first[i + 1]]) for i in range(part.num_rows)]


def _lists(rows: list[np.ndarray], dtype) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(offsets, pa.array(flat, dtype))


def sketches(docs: DataFrame, width: int = WIDTH, sketch: int = SKETCH, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n, d1, d2, sketch`` of every row: set size, two sums that stand
    for the whole set (128 bits) and the smallest hashes in order."""

    def run(batches):
        for part, sets in _row_sets(batches, width):
            with np.errstate(over="ignore"):
                d1 = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                d2 = [int(mix(s ^ _SIGN).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    _lists([_signed(s[:sketch]) for s in sets], pa.int64()),
                ],
                ["doc_id", "n", "d1", "d2", "sketch"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``node, members``: the whole set of each row of ``docs(node, text)``."""

    def run(batches):
        for part, sets in _row_sets(batches, width):
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array([m.tobytes() for m in sets], pa.binary())], ["node", "members"]
            )

    return docs.mapInArrow(run, "node long, members binary")


def _similar(threshold: int, sketch: int):
    """Keep pairs with both full sets ``x`` and ``y`` whose similarity reaches the
    threshold; the sketch of their union tells most others without the sets."""
    estimate = _estimates(threshold, sketch)

    def run(batches):
        for batch in batches:
            x = [np.frombuffer(m.as_buffer(), np.uint64) for m in batch.column("x")]
            y = [np.frombuffer(m.as_buffer(), np.uint64) for m in batch.column("y")]
            keep = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(x, y)):
                if estimate(p[:sketch], q[:sketch]):
                    union, common = _overlap(p, q)
                    keep[i] = 100 * len(common) >= threshold * len(union)
            yield batch.filter(pa.array(keep)).drop_columns(["x", "y"])

    return run


def _near(threshold: int, sketch: int):
    """Keep pairs whose sketches ``x`` and ``y`` make the threshold possible."""
    estimate = _estimates(threshold, sketch)

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = [estimate(x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["x", "y"])

    return run


def _overlap(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union and intersection of two sorted sets."""
    both = np.concatenate([p, q])
    both.sort()
    twice = both[1:] == both[:-1]
    return both[np.concatenate([[True], ~twice])], both[1:][twice]


def _estimates(threshold: int, sketch: int):
    """A test of two sketches: whether the sketch of their union shares enough values."""
    enough = shared_at_least(sketch + 1, threshold, sketch)

    def test(p: np.ndarray, q: np.ndarray) -> bool:
        union, common = _overlap(p, q)
        if len(union) > sketch:
            return (common <= union[sketch - 1]).sum() >= enough
        return 100 * len(common) >= threshold * len(union)

    return test


class _Matcher:
    """Tests pairs ``a, b`` of nodes, which may carry labels along."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, threshold: int, sketch: int):
        self.nodes, self.sets, self.threshold, self.sketch = nodes, sets, threshold, sketch

    def _with(self, pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        for end, name in (("b", "y"), ("a", "x")):
            pairs = pairs.join(table.select(F.col("node").alias(end), F.col(value).alias(name)), end)
        return pairs

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose union sketch does not rule them out."""
        names = [c for c in ("a", "b", "la", "lb") if c in pairs.columns]
        found = self._with(pairs, self.nodes, "sketch").select(*names, "x", "y")
        return found.mapInArrow(_near(self.threshold, self.sketch), pairs.select(*names).schema)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked pairs; written."""
        names = [c for c in ("a", "b", "la", "lb") if c in pairs.columns]
        found = self._with(pairs, self.sets, "members").select(*names, "x", "y")
        found = found.mapInArrow(_similar(self.threshold, self.sketch), pairs.select(*names).schema)
        return cut_lineage(found, "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair of two nodes once, the smaller first."""
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _gathered(shared: DataFrame) -> DataFrame:
    """A row per node of ``shared(node, n, label, v, df)``: its values, rarest first, and their count ``c``.

    ``shared`` has the values that other documents hold too, ``df`` in all; a
    node has no more of them than its set or sketch.
    """
    gathered = shared.groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))
    return gathered.select("node", "n", "label", F.size("s").alias("c"), F.col("s.v").alias("s"))


def _sketch_lists(nodes: DataFrame, threshold: int, sketch: int) -> DataFrame:
    """``v, node, label, c``: the lists of retained values; a node alone is its own label.

    Values that no other document retains are the rarest of all and use up places.
    """
    retained = nodes.select("node", "n", F.col("node").alias("label"), F.explode("sketch").alias("v"))
    often = retained.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    bounds = F.array(*[F.lit(shared_at_least(n, threshold, sketch)) for n in range(sketch + 2)])
    need = F.element_at(bounds, (F.least("n", F.lit(sketch + 1)) + 1).cast("int"))
    gathered = _gathered(retained.join(often, "v")).withColumn("take", F.col("c") - need + 1).filter("take > 0")
    return gathered.select(F.explode(F.slice("s", F.lit(1), F.col("take"))).alias("v"), "node", "label", "c")


def _set_lists(open_nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``v, low, high, band, node, n, label, c, bits``: lists of all shingles of nodes
    that may still link with another component.

    Only a shingle that another component holds too can be in common. Sizes
    fall into bands, and a node looks for partners band by band: sets of sizes
    n and m at the threshold t have t (n + m) / (1 + t) shingles in common, so
    a node with c shingles to share enters the lists of its
    ``c - that + 1`` rarest ones, where two linked nodes must meet.
    """

    def run(batches):
        for batch in batches:
            values = [np.frombuffer(m.as_buffer(), np.uint64) for m in batch.column("members")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"), batch.column("label"), _lists([_signed(m) for m in values], pa.int64()),
                    _lists([_parity(m) for m in values], pa.int64()),
                ],
                ["node", "label", "s", "bits"],
            )

    found = open_nodes.join(sets, "node").select("node", "label", "members")
    found = cut_lineage(found.mapInArrow(run, "node long, label long, s array<long>, bits array<long>"), "held")
    held = found.select("node", "label", F.size("s").cast("long").alias("n"), F.explode("s").alias("v"))
    foreign = held.groupBy("v").agg(
        F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high")
    ).filter("low <> high").select("v", "df")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int")
    reach = math.ceil(math.log(100 / threshold) / math.log(BAND)) + 1
    gathered = _gathered(held.join(foreign, "v")).withColumn("band", band)
    wanted = gathered.withColumn("other", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach)))
    # least size in the partner's band, lowered by a rounding error's worth
    size = F.pow(F.lit(BAND), F.col("other")) * (1 - 1e-9)
    up = lambda x: F.ceil(x / 100 - 1e-6)
    both = F.ceil((F.col("n") + size) * threshold / (100 + threshold) - 1e-6)
    need = F.greatest(both, up(F.col("n") * threshold), up(size * threshold))
    wanted = wanted.withColumn("take", (F.col("c") - need + 1).cast("int")).filter("take > 0")
    wanted = wanted.join(found.select("node", "bits"), "node")
    return wanted.select(
        F.explode(F.slice("s", F.lit(1), F.col("take"))).alias("v"), F.least("band", "other").alias("low"),
        F.greatest("band", "other").alias("high"), "band", "node", "n", "label", "c", "bits",
    )


def near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    threshold: int = THRESHOLD,
    sketch: int = SKETCH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, d1, d2``.

    ``component_id`` is the smallest id that links reach, ``kept`` marks the
    row's own id being that one. Linked are sets with
    ``100 * |A & B| >= threshold * |A | B|`` over ``width``-word shingles.
    """
    docs = small_batches(docs)
    rows = cut_lineage(sketches(docs, width, sketch, id_col, text_col), "sketches")
    present = rows.filter("n > 0 and doc_id is not null")
    # a node is one distinct set, named by its smallest id
    nodes = cut_lineage(
        present.groupBy("d1", "d2").agg(
            F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
        ),
        "nodes",
    )
    lists = cut_lineage(_sketch_lists(nodes, threshold, sketch), "lists")
    meeting = lists.select("node").distinct()
    plain = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    wanted = plain.join(meeting, "node", "left_semi").dropDuplicates(["node", "text"])
    sets = cut_lineage(full_sets(wanted, width), "members")
    matcher = _Matcher(nodes, sets, threshold, sketch)

    # every node against the first of its lists' pivots, those that share most with others
    heads = lists.groupBy("v").agg(F.min(F.struct((-F.col("c")).alias("c"), "node")).alias("p"))
    first = lists.join(heads, "v").groupBy("node").agg(F.min("p").alias("p"))
    tested = _ordered(first.select(F.col("p.node").alias("a"), F.col("node").alias("b")))
    links = matcher.links(tested)
    if not present.groupBy("doc_id").count().filter("count > 1").isEmpty():
        links = links.unionByName(_own_links(present, nodes))
    labels = components(links)

    # what is in a list with another component, by all of its shingles
    now = lists.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    left = _open_lists(now, ["v"]).select("node", "label").distinct()
    lists = _open_lists(cut_lineage(_set_lists(cut_lineage(left, "open"), sets, threshold), "lists"), KEY)
    # the order in which the members of a list become its pivots
    place = F.shiftrightunsigned(F.xxhash64("node", F.lit(7)), 32)
    lists = cut_lineage(lists.withColumn("place", place), "lists")
    joined, done, pivots = [], 0, PIVOTS
    while not lists.isEmpty():
        links = matcher.links(matcher.near(_list_pairs(lists, done, pivots, threshold)))
        lists = lists.filter(F.col("m") > pivots)
        if not links.isEmpty():
            joined.append(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
            merged = components(joined[-1]).select(F.col("node").alias("label"), F.col("label").alias("to"))
            lists = lists.join(merged, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        lists = cut_lineage(_open_lists(lists, KEY), "lists")
        done, pivots = pivots, pivots * PIVOTS
    classes = nodes.select("d1", "d2", "node").join(labels, "node", "left")
    classes = classes.select("d1", "d2", F.coalesce("label", "node").alias("class"))
    if joined:
        merged = components(reduce(DataFrame.unionByName, joined))
        merged = merged.select(F.col("node").alias("class"), F.col("label").alias("to"))
        classes = classes.join(merged, "class", "left").select("d1", "d2", F.coalesce("to", "class").alias("class"))
    return _result(rows, classes)


def _own_links(present: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of one id's texts."""
    return (
        present.join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).filter("doc_id <> node")
        .join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    )


def _list_pairs(lists: DataFrame, done: int, pivots: int, threshold: int) -> DataFrame:
    """``a, b, la, lb``: the lists' pivots with the members of other components.

    Pivots are those whose place in the list's order, a number below 2**32, is
    in the share from ``done`` to ``pivots`` of its ``m`` members.
    """
    upto = F.least(F.lit(1 << 32), F.floor(F.lit(float(pivots) * (1 << 32)) / F.col("m")))
    before = F.least(F.lit(1 << 32), F.floor(F.lit(float(done) * (1 << 32)) / F.col("m")))
    names = ("node", "label", "n", "c", "band", "bits")
    side = lambda frame, end: frame.select(*KEY, "salt", *[F.col(c).alias(f"{c}_{end}") for c in names])
    # a large list is dealt over several tasks, each with all of its pivots
    tasks = F.ceil(F.col("m") / LIST_ROWS)
    heads = lists.filter((F.col("place") < upto) & (F.col("place") >= before))
    heads = side(heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))), "a")
    others = side(lists.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(11)), tasks)), "b")
    # |A & B| is at most c of either, and so the union at least the rest
    alike = F.least("c_a", "c_b") * (100 + threshold) >= (F.col("n_a") + F.col("n_b")) * threshold
    # no fewer values are in one set alone than there are unequal parities
    unequal = reduce(
        lambda x, y: x + y, [F.bit_count(F.get("bits_a", i).bitwiseXOR(F.get("bits_b", i))) for i in range(PARITIES // 64)]
    )
    alike &= unequal * (100 + threshold) <= (F.col("n_a") + F.col("n_b")) * (100 - threshold)
    across = (F.col("low") == F.col("high")) | (F.col("band_a") != F.col("band_b"))
    pairs = heads.join(others, [*KEY, "salt"]).filter((F.col("label_a") != F.col("label_b")) & across & alike)
    turned = F.col("node_a") > F.col("node_b")
    return pairs.select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"),
        F.when(turned, F.col("label_b")).otherwise(F.col("label_a")).alias("la"),
        F.when(turned, F.col("label_a")).otherwise(F.col("label_b")).alias("lb"),
    ).distinct()


def _open_lists(lists: DataFrame, key: list[str]) -> DataFrame:
    """The lists whose members are in several components, with their size ``m``.

    A list for two bands needs members of both.
    """
    banded = "band" in lists.columns
    spread = lists.groupBy(key).agg(
        F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("m"),
        *([F.min("band").alias("b1"), F.max("band").alias("b2")] if banded else []),
    ).filter("first <> last")
    if banded:
        spread = spread.filter("low = high or b1 <> b2")
    return lists.drop("m").join(spread.select(*key, "m"), key)


def _result(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Component ids of all rows from the classes of the sets."""
    return (
        rows.drop("sketch").join(classes, ["d1", "d2"], "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class"))
            .otherwise(F.col("doc_id")).alias("component_id"),
            "d1", "d2",
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(
    docs: DataFrame,
    width: int = WIDTH,
    threshold: int = THRESHOLD,
    sketch: int = SKETCH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` less all but one document of each component.

    Rows without an id or without words stay as they are. Of rows with one id
    that are kept, those with equal texts become one row, and of different
    texts of one id the one with the smallest checksum stays.
    """
    found = near_duplicates(docs, width, threshold, sketch, id_col, text_col).filter("n_shingles > 0 and doc_id is not null")
    gone = found.filter("not kept").select("doc_id").distinct()
    repeated = found.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    marks = cut_lineage(
        gone.withColumn("mark", F.lit("gone")).unionByName(repeated.withColumn("mark", F.lit("one"))), "marks"
    ).withColumnRenamed("doc_id", "of")
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("sum"),
        F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"),
    )
    marked = rows.join(marks, F.col("id") == F.col("of"), "left").withColumn("mark", F.when(F.col("words"), F.col("mark")))
    plain = marked.filter("mark is null").select("row")
    one = marked.filter("mark = 'one'").dropDuplicates(["of", "sum"])
    least = one.groupBy("of").agg(F.min("sum").alias("sum"))
    return plain.unionByName(one.join(least, ["of", "sum"], "left_semi").select("row")).select("row.*")
