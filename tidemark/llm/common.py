"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session, as in tests, gets a folder of its own where the setting is missing.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    path = getattr(spark, "_own_shared_dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(path)
        spark._own_shared_dir = path
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of rows handed to a Python worker at a time, where the session allows more.
BATCH_BYTES = 4 << 20


def modest_batches(spark: SparkSession) -> None:
    """Keep batches of whole texts small, so that a worker's memory does not depend on how long texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def saved(df: DataFrame, name: str, mark: Column | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back, so that lost executors cost no recomputation of what lies before.

    Rows are counted, and the aggregate ``mark`` is taken, on the way.
    """
    path, seen = new_folder(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *([] if mark is None else [mark.alias("mark")])).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at, out._rows, out._mark = path, seen.get["rows"], seen.get.get("mark")
    tables_of(df.sparkSession).append(path)
    return out


def tables_of(spark: SparkSession) -> list[str]:
    """Folders that ``saved`` wrote in this session and that were not deleted yet."""
    if getattr(spark, "_saved_tables", None) is None:
        spark._saved_tables = []
    return spark._saved_tables


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in tables_of(spark):
        tables_of(spark).remove(path)


def discard(df: DataFrame | None) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    path = getattr(df, "_saved_at", None)
    if path:
        remove_folder(df.sparkSession, path)


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends only on the columns' values and the seed."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


#: Rows, or entries of their arrays, of a side that is broadcast; beyond it the join shuffles.
MOST_BROADCAST = 500_000


def small(df: DataFrame, entries: str | None = None, rows: int | None = None) -> DataFrame:
    """The same table, marked for broadcast if its rows (a few numbers each) are counted and few enough.

    ``entries`` names an array column whose entries count instead; ``rows`` is their number, or a bound, where that is known.
    """
    if rows is not None:
        size = rows
    elif entries:
        size = df.agg(F.coalesce(F.sum(F.size(entries)), F.lit(0))).first()[0]
    else:
        size = rows_of(df)
    return F.broadcast(df) if size <= MOST_BROADCAST else df


def rows_of(df: DataFrame) -> int:
    """The rows of a table: counted as they were written, if ``saved`` did that."""
    return df._rows if getattr(df, "_rows", None) is not None else df.count()


#: Rows of a table of links for each task that writes it, and the fewest tasks.
LINKS_IN_TASK, LEAST_TASKS = 1 << 13, 8


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of an undirected graph: ``node`` and ``component``.

    ``edges`` has long columns ``a`` and ``b``; every node of an edge has a row.  Alternates the large-star and small-star
    steps until every node is the smallest of its component or has one link, to that.  All state is distributed and each step
    is a table in the shared folder; smallest neighbours are written before they are joined, so that a node with very many
    neighbours is split over tasks.  As links are counted, their tables are written by no more tasks than these need, however
    many partitions the session shuffles to.  Null ends are ignored; self loops keep their node; no edges give an empty result.  Result and edges together with further edges can
    be edges again.  The result rests on a table in the shared folder.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    first = now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", F.count_if(F.col("u") == F.col("v")))

    def written(df: DataFrame, name: str, mark: Column | None = None) -> DataFrame:
        return saved(df.coalesce(max(LEAST_TASKS, now._rows // LINKS_IN_TASK)), name, mark)

    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node links to the smallest node among it and its neighbours.
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.max("v").alias("top"))
        unsettled = (F.col("below") > 1) | ((F.col("below") > 0) & (F.col("top") > F.col("u")))
        low = written(near.select("u", F.least("m", "u").alias("m"), unsettled.alias("unsettled")), "low", F.count_if("unsettled"))
        if not low._mark:
            break
        large = written(both.where("v > u").join(small(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # Small star: a node and its smaller neighbours link to the smallest of them.
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        step = large.join(small(lower), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, written(step.union(lower.select("u", F.col("m").alias("v"))).distinct(), "links")
        for table in (low, large, lower, *([] if last is first else [last])):
            discard(table)
    else:
        raise RuntimeError("connected components did not settle")
    # Every link now leads straight to the smallest node, which has none itself; of nodes with a self loop alone only the first table tells.
    out = low.select(F.col("u").alias("node"), F.col("m").alias("component"))
    if first._mark and now is not first:
        loops = first.where("u = v").select("u", "v")
        out = saved(out.union(loops).groupBy("node").agg(F.min("component").alias("component")), "components")
        discard(low)
    else:
        out._saved_at, out._rows = low._saved_at, low._rows
    for table in (first, *([] if now is first else [now])):
        discard(table)
    return out
