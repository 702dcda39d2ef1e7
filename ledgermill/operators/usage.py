"""Token use per model over the trailing minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .ordering import PLACE, SEGMENT, before, null_safe_join, spread_join, place_rows


def estimate_tokens(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / 3)).cast("long")


def token_budget(
    calls: DataFrame,
    limit: int = C.MAIN_MODEL_TOKENS_PER_MINUTE,
    *,
    window_seconds: int = C.RATE_WINDOW_SECONDS,
    margin: float = C.RATE_SAFETY_MARGIN,
    segments: int | None = None,
) -> DataFrame:
    """Tokens of the trailing window per call, and whether that is too much.

    ``calls(call_id, model, ts, tokens)``. A line sweeps over time: a call
    adds its tokens at its time and takes them back when its window is over,
    so the sum of all changes up to a call is what its window holds. Changes
    of one moment are added first; the running sum goes by segments of a
    model's moments with what earlier segments add up to carried along, so a
    model with nearly all calls in one minute spreads too, and the work grows
    with the calls, not with how many share a window. Calls without a time
    share one moment of their own.
    """
    reach = window_seconds * 1_000_000
    timed = calls.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    change = lambda at, sign, own: F.struct(
        at.alias("_at"), (F.col("tokens") * sign).alias("tokens"), F.lit(sign).cast("long").alias("n"),
        F.lit(own).cast("long").alias("own"),
    )
    changes = timed.select("model", "_at", "tokens").filter("_at is not null").select(
        "model", F.inline(F.array(change(F.col("_at"), 1, 1), change(F.col("_at") + reach + 1, -1, 0)))
    )
    moments = changes.groupBy("model", "_at").agg(*[F.sum(c).alias(c) for c in ("tokens", "n", "own")])
    placed = place_rows(moments, ["model"], ["_at"], segments)
    carried = placed.groupBy("model", SEGMENT).agg(F.sum("tokens").alias("_t"), F.sum("n").alias("_n")).select(
        "model", SEGMENT, *[F.coalesce(F.sum(c).over(before(["model"])), F.lit(0)).alias(c) for c in ("_t", "_n")]
    )
    so_far = Window.partitionBy("model", SEGMENT).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    sums = null_safe_join(placed, carried, ["model", SEGMENT]).select(
        "model", "_at", "own",
        (F.sum("tokens").over(so_far) + F.col("_t")).alias("used_tokens"), (F.sum("n").over(so_far) + F.col("_n")).alias("_calls"),
    ).filter("own > 0")
    timeless = timed.filter("_at is null").groupBy("model", "_at").agg(
        F.count(F.lit(1)).alias("own"), F.sum("tokens").alias("used_tokens"), F.count(F.lit(1)).alias("_calls")
    )
    used = spread_join(timed, sums.unionByName(timeless), ["model", "_at"], ["call_id"], size="own")
    return used.withColumn(
        "over_budget", (F.col("used_tokens") > F.lit(limit * margin)) & (F.col("_calls") > 1)
    ).drop("_at", "_calls", "own")
