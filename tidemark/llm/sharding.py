"""Output shards of near equal size by sampled splitters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved, uniform

#: Bytes that one range should hold, and size-weighted samples drawn for each range.
RANGE_BYTES, OVERSAMPLE = 64 << 20, 8
#: The driver receives this many samples or range totals at most; beyond it, ranges grow instead.
MAX_RANGES = 200_000


def _range_of(splitters: np.ndarray):
    """A column function: the number of splitters (rows k1, k2, in order) at or below a key."""
    first, second = np.ascontiguousarray(splitters[:, 0]), np.ascontiguousarray(splitters[:, 1])

    @F.pandas_udf("int")
    def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k1, k2 in parts:
            a, b = k1.to_numpy(np.int64), k2.to_numpy(np.int64)
            low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
            for i in np.flatnonzero(low < high):  # several splitters within one hot first key
                low[i] += np.searchsorted(second[low[i] : high[i]], b[i], "right")
            yield pd.Series(low.astype(np.int32))

    return found


def _sample(keyed: DataFrame, n: int) -> np.ndarray:
    """Keys of n rows drawn without replacement with chances in proportion to size; the draw depends on values alone."""
    drawn = keyed.where("_size > 0").select("_k1", "_k2", (-F.log(uniform("_k1", "_k2", seed=11)) / F.col("_size")).alias("_p"))
    rows = drawn.orderBy("_p", "_k1", "_k2").limit(n).collect()
    keys = np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1, 2)
    return keys[np.lexsort((keys[:, 1], keys[:, 0]))]


def _quantiles(sample: np.ndarray, parts: int) -> np.ndarray:
    if len(sample) == 0 or parts < 2:
        return np.empty((0, 2), np.int64)
    return np.unique(sample[np.arange(1, parts) * len(sample) // parts], axis=0)


def shard_by_size(
    df: DataFrame, n_shards: int, *, size: Column, group: Column, tie: Column, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Every row with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 within the shard).

    Rows are ordered by ``group`` and then ``tie`` (both long; rows of one group stay side by side).  Size-weighted key
    samples give quantile boundaries of ranges of about ``range_bytes``; every range is totalled exactly, and ranges of
    over twice that are sampled again and subdivided, within a hot group by ``tie``.  The running size over the ranges
    then cuts the order into shards: shard sizes differ from each other by about one row's size.  No range is dropped or
    truncated, and no task holds more than a range, so a hot group is spread like any other.

    Null sizes count 0, null keys sort first; an empty table gives an empty result; rows equal in both keys are taken in
    any order, which matters only where their other columns differ.  Input columns named shard or slot are replaced.
    """
    keyed = df.drop("shard", "slot").withColumns(
        {"_size": F.coalesce(size, F.lit(0)).cast("long"), "_k1": F.coalesce(group, F.lit(-(2**63))), "_k2": F.coalesce(tie, F.lit(-(2**63)))}
    )
    slim = saved(keyed.select("_size", "_k1", "_k2"), "keys")  # the texts are not read again until rows are given out
    total, rows = slim.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    n_ranges = int(min(MAX_RANGES, max(n_shards * 8, total // range_bytes + 1, rows // 1_000_000 + 1)))
    splitters = _quantiles(_sample(slim, n_ranges * OVERSAMPLE), n_ranges)

    def totals(splitters: np.ndarray) -> dict[int, tuple[int, int]]:
        ranged = slim.withColumn("_r", _range_of(splitters)("_k1", "_k2"))
        return {r[0]: (r[1], r[2]) for r in ranged.groupBy("_r").agg(F.sum("_size"), F.count("*")).collect()}

    sums = totals(splitters)
    most = 2 * total / n_ranges
    while over := {r: s for r, (s, _) in sums.items() if s > most}:
        ids = F.broadcast(df.sparkSession.createDataFrame([(r,) for r in over], "_r int"))  # half the ranges at most
        inside = slim.withColumn("_r", _range_of(splitters)("_k1", "_k2")).join(ids, "_r", "left_semi")
        more = _quantiles(_sample(inside, n_ranges * OVERSAMPLE), int(sum(over.values()) / most * 4) + 2)
        both = np.unique(np.concatenate([splitters, more]), axis=0)
        if len(both) == len(splitters):  # a single key, repeated in whole rows, cannot be divided
            break
        splitters, sums = both, totals(both)

    order = sorted(sums)
    ahead = {}
    done = (0, 0)
    for r in order:
        ahead[r] = done
        done = (done[0] + sums[r][0], done[1] + sums[r][1])
    ranged = _with_position(keyed, splitters, ahead)
    shard = F.least(F.lit(n_shards - 1), F.floor((F.col("_before") * 2 + F.col("_size")) * n_shards / F.lit(max(1, 2 * total)))).cast("int")
    # Where each shard begins, from the keys and sizes alone; the texts are moved once, below.
    starts = (
        _with_position(slim, splitters, ahead)
        .groupBy(shard.alias("shard")).agg(F.min("_row").alias("_first")).collect()
    )
    firsts: Sequence[tuple[int, int]] = sorted((r[1], r[0]) for r in starts)
    if not firsts:
        firsts = [(0, 0)]
    shard_col, first_col = F, F
    for first, number in reversed(firsts):
        shard_col = shard_col.when(F.col("_row") >= first, F.lit(number))
        first_col = first_col.when(F.col("_row") >= first, F.lit(first))
    placed = ranged.withColumns({"shard": shard_col.cast("int"), "slot": (F.col("_row") - first_col).cast("long")})
    return placed.drop("_size", "_k1", "_k2", "_r", "_before", "_row")


def _with_position(keyed: DataFrame, splitters: np.ndarray, ahead: dict[int, tuple[int, int]]) -> DataFrame:
    """Adds _row and _before: rows and bytes ahead of the row in the whole order."""
    offsets = keyed.sparkSession.createDataFrame([(r, b, c) for r, (b, c) in ahead.items()], "_r int, _b0 long, _c0 long")
    w = Window.partitionBy("_r").orderBy("_k1", "_k2")
    ranged = keyed.withColumn("_r", _range_of(splitters)("_k1", "_k2")).join(F.broadcast(offsets), "_r")
    run = F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumns({"_before": F.col("_b0") + run - F.col("_size"), "_row": F.col("_c0") + F.row_number().over(w) - 1}).drop("_b0", "_c0")
