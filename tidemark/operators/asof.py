"""As-of pairing within a tolerance, without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(
    left: DataFrame, right: DataFrame, columns: Sequence[str], tolerance_ms: int, keys: Sequence[str] = (), *, at_earlier_time: bool = False
) -> DataFrame:
    """``left`` with ``columns`` of the latest earlier row of ``right`` by (ts_ms, seq), null if older than the tolerance.

    Time is cut into buckets as wide as the tolerance.  A row of ``right`` is laid into its own bucket and the next, so each
    bucket holds all that its rows of ``left`` can be paired with and is a partition of its own; nothing is sorted globally.
    ``keys`` names columns that both sides must share.  With ``at_earlier_time`` a row of the same time is never earlier,
    whatever its seq; of several rows of ``right`` at the latest time the last by seq counts.
    """
    own = left.columns
    bucket = F.floor(F.col("ts_ms") / tolerance_ms)
    found = F.struct(F.col("ts_ms").alias("_at"), *[F.col(c) for c in columns])
    r = right.select(*keys, "ts_ms", "seq", found.alias("_found"), F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
    rows = F.struct(*[F.col(c) for c in own])
    both = left.select(*keys, "ts_ms", "seq", rows.alias("_row"), bucket.alias("_bucket")).unionByName(r, allowMissingColumns=True)
    # Of rows at the same time and place in the order, those of the left see only what came before.
    order = [F.col("_row").isNull(), F.col("seq")] if at_earlier_time else [F.col("seq"), F.col("_row").isNull()]
    w = Window.partitionBy(*keys, "_bucket").orderBy("ts_ms", *order).rowsBetween(Window.unboundedPreceding, -1)
    paired = both.withColumn("_last", F.last("_found", ignorenulls=True).over(w)).where("_row is not null")
    fresh = F.when(F.col("ts_ms") - F.col("_last._at") <= tolerance_ms, F.col("_last"))
    out = paired.withColumn("_last", fresh)
    return out.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in columns], F.col("_last._at").alias("paired_ts_ms"))
