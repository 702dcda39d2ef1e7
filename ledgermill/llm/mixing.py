"""Sources mixed to target weights by Poisson replication.

Every source has a target share of the mixed bytes. Its mean repetition rate
is that share of the budget over its own bytes. A document's number of copies
is the Poisson distribution with that mean, inverted at a uniform value that a
seeded hash of the document's id gives, so it is the same in every run and for
any partitioning. Copies are exploded and put in one random order over all.

Edge cases: a null source is a source of its own; a source without bytes has
rate 0 unless it has weight, then its rows count one byte each; sources
without a weight get none; rows of one id get one count, each its own copies;
a null id hashes as the text "null". An empty table gives an empty result.
Columns named as the added ones are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SEED = 42
TEMPERATURE = 0.5
BITS = 52


def poisson_cuts(rate: float) -> list[int]:
    """The distribution function at 0, 1, 2, ... as whole numbers of ``2**-BITS``."""
    if rate <= 0:
        return []
    most = math.ceil(rate + 12 * math.sqrt(rate) + 40)
    k = np.arange(most + 1)
    logs = np.array([math.lgamma(i + 1) for i in k])
    mass = np.exp(k * math.log(rate) - rate - logs)
    cuts = np.floor(np.minimum(np.cumsum(mass), 1.0) * 2.0**BITS).astype(np.int64)
    return cuts[: int(np.searchsorted(cuts, 2**BITS)) + 1].tolist()


def source_rates(
    docs: DataFrame, weights: DataFrame | None = None, budget: int | None = None,
    temperature: float = TEMPERATURE, source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``source, bytes, rate`` of each source.

    ``weights`` is a table ``source, weight``; without it weights are the
    sources' bytes to the power ``temperature``. ``budget`` is the bytes
    of the mixture, by default those of the input.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(
        F.sum(F.greatest(F.coalesce(F.octet_length(text_col), F.lit(0)), F.lit(1))).alias("bytes")
    )
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(temperature)))
    else:
        own = weights.groupBy(F.col("source").alias("of")).agg(F.sum("weight").alias("weight"))
        sizes = sizes.join(own, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        sizes = sizes.fillna(0.0, ["weight"])
    sizes = cut_lineage(sizes, "sources")
    total = sizes.agg(F.sum("bytes").alias("b"), F.sum("weight").alias("w")).first()
    budget = total["b"] if budget is None else budget
    share = F.col("weight") / F.lit(total["w"] or 1.0)
    return sizes.select("source", "bytes", (share * F.lit(float(budget or 0)) / F.col("bytes")).alias("rate"))


def _cuts(rates: pd.Series) -> pd.Series:
    return rates.map(poisson_cuts)


def uniform(seed: int, *parts):
    """A hash as a whole number below ``2**BITS``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame, rates: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """Copies in shuffled order: the columns with ``copy`` (from 1), ``n_copies``, ``order_key``.

    The table of rates is written first, so that Spark knows its size when it
    chooses between broadcasting it and a join that splits skewed sources.
    """
    added = ("copy", "n_copies", "order_key")
    kept = [c for c in docs.columns if c not in added]
    cuts = cut_lineage(rates.select(F.col("source").alias("of"), F.pandas_udf(_cuts, "array<long>")("rate").alias("cuts")), "rates")
    rows = docs.select(
        F.struct(*kept).alias("row"), F.col(source_col).cast("string").alias("own"),
        uniform(seed, F.col(id_col)).alias("u"), F.col(id_col).alias("id"),
    )
    counted = rows.join(cuts, F.col("own").eqNullSafe(F.col("of"))).withColumn(
        "n_copies", F.size(F.filter("cuts", lambda x: x <= F.col("u"))).cast("long")
    )
    copies = counted.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.select(
        "row", F.col("copy").cast("long").alias("copy"), "n_copies",
        uniform(seed + 1, F.col("id"), F.col("copy")).alias("order_key"), F.monotonically_increasing_id().alias("place"),
    )
    ordered = keyed.repartitionByRange("order_key", "place").sortWithinPartitions("order_key", "place")
    return ordered.select("row.*", *added)
