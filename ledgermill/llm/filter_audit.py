"""What each filter removes under every order of the filters.

A row's failures are one bit mask, so every order follows from the counts per
part and mask. The applied filters form a lattice of subsets: a state is the
set applied so far, an edge applies one more filter, an order is a path from
the empty to the full set. Counting paths forwards gives the orders that reach
a state, counting backwards those that lead on from it; their product at an
edge is the number of orders that use the edge. An edge's removals do not
depend on how its state was reached: weighted by that product they add up to a
filter's removals over all orders, its Shapley value times the number of
orders, and the steps of a single order are read from the edges on its path.

Filters are Column expressions that tell whether a row fails. One more may be
a duplicate filter: a row fails it if a row with a smaller id has the same
text, whatever the other filters do. Equal texts meet as digests, which are
counted before they shuffle, so neither texts nor large groups of copies travel.

Edge cases: a null text is empty. A null part is the empty text. A row without
an id never fails the duplicate filter and makes no other row fail it; rows of
one id do not make each other fail. A label covers all rows of its id; rows
of one id in the labels count together. Rows without an id or label are
neither good nor toxic. An empty table gives an empty report. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import settle

# Fixed values ---------------------------------------------------------------
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 3  # percent of the characters
SYMBOLS = r"[#$%&*|]"
GAPS = r"[\x20\x09-\x0D]+"
# ----------------------------------------------------------------------------


def lattice(filters: int) -> list[tuple[int, int, int]]:
    """``state, filter, orders`` for every edge: how many orders apply the filter in that state."""
    full = (1 << filters) - 1
    grows = [(s, f) for s in range(full) for f in range(filters) if not s >> f & 1]
    reach, leave = [1] + [0] * full, [0] * full + [1]
    for s, f in grows:
        reach[s | 1 << f] += reach[s]
    for s, f in reversed(grows):
        leave[s] += leave[s | 1 << f]
    return [(s, f, reach[s] * leave[s | 1 << f]) for s, f in grows]


def text_filters(text: str = "text") -> dict[str, Column]:
    """The failure conditions A to D of columns made by ``measured``."""
    c = F.col
    return {
        "A": c("words") < LEAST_WORDS,
        "B": 100 * c("different") < LEAST_DISTINCT * c("words"),
        "C": 100 * c("capitals") > MOST_CAPITALS * F.length(text),
        "D": F.col(text).rlike(SYMBOLS),
    }


def measured(rows: DataFrame) -> DataFrame:
    """``rows(text)`` with counts of words, different words and capitals."""
    # what a split leaves before the first and after the last gap is an empty piece
    rows = settle(rows, pieces=F.split("text", GAPS, -1), capitals=F.length(F.regexp_replace("text", "[^A-Z]+", "")))
    ends = lambda x: (x == "").cast("int")
    n = F.size("pieces")
    empty = F.when(n == 1, ends(F.get("pieces", F.lit(0)))).otherwise(
        ends(F.get("pieces", F.lit(0))) + ends(F.get("pieces", n - 1))
    )
    return settle(
        rows, words=n - empty, different=F.size(F.array_distinct("pieces")) - F.least(empty, F.lit(1))
    ).drop("pieces")


def failure_masks(docs: DataFrame, part_col="lang", id_col="doc_id", text_col="text") -> DataFrame:
    """``id, part, mask, digest`` of every row; bit k of the mask is the k-th text filter."""
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    bits = [F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(text_filters().values())]
    return measured(plain).select("id", "part", sum(bits[1:], bits[0]).alias("mask"), F.sha2("text", 256).alias("digest"))


def failure_cube(masks: DataFrame, labels: DataFrame, duplicate_bit: int, id_col="doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: rows per part and set of failed filters.

    The duplicate filter is added as bit ``duplicate_bit``. Of equal texts all
    rows fail it whose id is not the smallest one. Copies are counted per part
    before they meet, with the count at their smallest id beside, so of each
    text a few rows meet however often it occurs.
    """
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    rows = masks.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n")).join(known, "id", "left")
    rows = rows.fillna(0, ["good", "toxic"])
    # of rows with one id and all else alike there is one by now
    alike = ["digest", "part", "mask", "good", "toxic", F.col("id").isNull().alias("nameless")]
    copies = rows.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", F.struct("id")).alias("n_least")
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    stay = F.when(F.col("nameless"), F.col("n")).when(F.col("least") == first, F.col("n_least")).otherwise(F.lit(0))
    split = copies.withColumn("stay", stay).select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct("mask", F.col("stay").alias("n")),
            F.struct((F.col("mask") + (1 << duplicate_bit)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")),
        )),
    )
    return split.filter("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def edge_counts(cube: DataFrame, filters: int) -> DataFrame:
    """Counts of every part at every edge of the lattice, with the edge's number of orders."""
    edges = F.array(*[
        F.struct(
            F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(w).cast("long").alias("orders")
        )
        for s, f, w in lattice(filters)
    ])
    at = cube.select("*", F.inline(edges))
    mask, bit = F.col("mask"), F.col("bit")
    fails, before = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("state")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))
    return at.groupBy("part", "state", "filter", "orders").agg(
        total(~fails & ~before).alias("kept"),
        total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~before, "good").alias("good_lost"),
        total(fails & ~before, "toxic").alias("toxic_lost"),
    )


def orders(spark, names: str) -> DataFrame:
    """``filter_order, step, state, filter``: the edges on the path of every order."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[k] for k in order), step, state, f))
            state |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")


def audit(
    docs: DataFrame, labels: DataFrame, part_col="lang", id_col="doc_id", text_col="text"
) -> DataFrame:
    """One row per part, order and step; see the module's text."""
    names = "".join(text_filters()) + "E"
    masks = failure_masks(docs, part_col, id_col, text_col)
    edges = edge_counts(failure_cube(masks, labels, len(names) - 1, id_col), len(names))
    weighted = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter"))
    steps = F.broadcast(orders(docs.sparkSession, names))
    return edges.withColumn("shapley", weighted).join(steps, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
