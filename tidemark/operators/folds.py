"""Folds over rows in order, one pass for each key, in Arrow batches; and tables that cut lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that a fold gives out.
BATCH_ROWS = 10_000


class Fold(Protocol):
    """What has been seen of one key so far."""

    def add(self, *row) -> Iterable[tuple]:
        """The results that this row brings about."""

    def close(self) -> Iterable[tuple]:
        """The results that the end of the key brings about."""


def fold_sorted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], start: Callable[[tuple], Fold], schema: str, order: Sequence[str] = ("ts_ms", "seq")) -> DataFrame:
    """Rows of each key in order go into a fold of their own; results are the key, then what the fold gives.

    A task holds one fold and one batch at a time, however many rows a key has: keys are laid side by side by one shuffle,
    sorted with spilling, and streamed.  The rows of one key are one after another by nature, so choose keys as fine as the
    meaning allows.  ``schema`` names the keys first.  Null keys are a key; an empty table gives an empty result.
    """
    n, arrow = len(keys), to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, out = None, None, []

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            out.clear()
            return rows

        for part in batches:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if row[:n] != now:
                    if fold is not None:
                        out.extend((*now, *x) for x in fold.close())
                    now, fold = row[:n], start(row[:n])
                out.extend((*now, *x) for x in fold.add(*row[n:]))
                if len(out) >= BATCH_ROWS:
                    yield batch()
        if fold is not None:
            out.extend((*now, *x) for x in fold.close())
        if out:
            yield batch()

    own = [c for c in columns if c not in keys]
    dealt = df.select(*keys, *own, *[F.col(c).alias(f"_order_{c}") for c in order]).repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, *[f"_order_{c}" for c in order])
    return dealt.select(*keys, *own).mapInArrow(run, schema)


def ddl(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.  A local session without that setting gets a
    folder of its own."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if place is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    return place.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that numbers that depend on how rows lie are drawn once."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def geometric_sum(value: Column, gain: Callable[[Column], Column], log_kept: Callable[[Column], Column], n: Column, total: Column) -> Column:
    """What a fold x + g(k) * (value - x) from 0 adds up to over the rows 1 to total, as a plain sum: each value weighs its gain and what
    later gains leave of it.  ``log_kept`` gives the sum of log(1 - g) up to a row."""
    return F.sum(value * gain(n) * F.exp(log_kept(total) - log_kept(n)))
