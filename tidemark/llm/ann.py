"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, saved

#: Vectors that a fit reads at most (those with the smallest hash of vec_id); the index itself holds every vector.
FIT_VECTORS, MOST_LISTS = 32_768, 4_096
#: Dimensions in one quantised part, and code words of a part.
PART_DIMS, CODE_WORDS = 2, 256
#: Vectors and queries that meet in one task; longer lists are split into such chunks.
CHUNK_VECTORS, CHUNK_QUERIES = 65_536, 2_048


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int32)
    norms = (centers**2).sum(1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin(norms - 2 * (x[at : at + 4096] @ centers.T), axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centers of at most k clusters; a center that loses all its members keeps its place."""
    x = np.asarray(x, np.float32)
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        n = np.bincount(near, minlength=len(centers))
        sums = np.stack([np.bincount(near, x[:, d], len(centers)) for d in range(x.shape[1])], 1)
        centers[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
    return centers


@dataclass
class Index:
    """What a fit learns; its size is bounded by FIT_VECTORS and MOST_LISTS."""

    centers: np.ndarray
    books: np.ndarray  # part, code word, dimension of the part
    probes: int
    slack: float  # what a score from codes may differ from the exact one

    def padded(self, x: np.ndarray) -> np.ndarray:
        parts, _, dims = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * dims - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list of each vector, codes of its residual)."""
        lists = _nearest(x, self.centers)
        rest = self.padded(x - self.centers[lists])
        dims = self.books.shape[2]
        codes = np.stack([_nearest(rest[:, m * dims : (m + 1) * dims], b) for m, b in enumerate(self.books)], 1)
        return lists, codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric tables: inner products of the parts of q with the code words (query, part, code word)."""
        parts, _, dims = self.books.shape
        return np.einsum("qmd,mkd->qmk", self.padded(q).reshape(len(q), parts, dims), self.books)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The lists to search, by the inner product with their centers, the best first."""
        return np.argsort(-(q @ self.centers.T), axis=1, kind="stable")[:, : self.probes]


def fit_index(vectors: np.ndarray, total: int, k: int, coverage: float = 0.97) -> Index:
    """Learn lists, code books and how many lists to probe, so that these hold ``coverage`` of the nearest in the sample."""
    x = np.ascontiguousarray(vectors, np.float32)
    n_lists = max(1, min(MOST_LISTS, int(math.sqrt(total)), len(x)))
    centers = k_means(x, n_lists)
    near = _nearest(x, centers)
    parts = -(-x.shape[1] // PART_DIMS)
    rest = np.pad(x - centers[near], ((0, 0), (0, parts * PART_DIMS - x.shape[1])))
    books = np.zeros((parts, CODE_WORDS, PART_DIMS), np.float32)
    for m in range(parts):
        found = k_means(rest[:, m * PART_DIMS : (m + 1) * PART_DIMS], CODE_WORDS)
        books[m] = found[np.arange(CODE_WORDS) % len(found)]
    index = Index(centers, books, len(centers), 0.0)
    q = x[:: max(1, len(x) // 256)][:256]
    exact = q @ x.T
    _, codes = index.encode(x)
    coded = centers[near] @ q.T
    for m in range(parts):
        coded += (books[m][codes[:, m]] @ np.pad(q, ((0, 0), (0, parts * PART_DIMS - q.shape[1])))[:, m * PART_DIMS : (m + 1) * PART_DIMS].T)
    index.slack = float(3 * np.std(exact - coded.T))
    best = np.argpartition(-exact, min(k + 1, len(x)) - 1, axis=1)[:, : k + 1]
    place = np.argsort(np.argsort(-(q @ centers.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    index.probes = min(len(centers), int(ranks[min(len(ranks) - 1, math.ceil(coverage * len(ranks)))]) + 1)
    return index


def _usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best scores; of equal ones the first."""
    if len(scores) <= most:
        return np.arange(len(scores))
    edge = np.partition(scores, -most)[-most]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: most - len(above)]])


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int, *, id: str = "vec_id", vector: str = "embedding", fit_vectors: int = FIT_VECTORS
) -> DataFrame:
    """The ``k`` rows with the largest inner product for every query row: query_id, rank (from 1), vec_id, score.

    Every usable row is indexed; of equal vectors the k + 1 with the smallest ids, as no other can be among the nearest.
    Equal queries are asked once.  A query is first asked of the list whose center is nearest; the (k + 1)-th best score there
    is its floor in the other lists that it probes.  In each chunk of a list, the vectors whose score from codes is not lower
    than the floor, or without one the chunk's own (k + 1)-th best score from codes, less what codes may err, are scored
    exactly, in double precision, and the best k + 1 are kept.  A query that so gets fewer is asked of all lists.  Ties go to
    the smaller id.  Long lists and busy lists are split into chunks that meet in separate tasks.

    Rows with a null id, a null, zero or non-finite vector, or another dimension than most of the sample take no part;
    rows that repeat an id count once (the smallest vector).  With fewer than k others, all are returned.  No usable query
    or vector gives an empty result.  Other columns are ignored.
    """
    spark, most = vectors.sparkSession, k + 1  # a query itself may be among the best
    slim = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("v"), is_query.alias("q"))
    rows = slim.where(F.col("vec_id").isNotNull() & _usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = rows_table = saved(rows, "vectors")
    drawn = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_vectors).toArrow()
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = pc.list_value_length(drawn["v"])
    dims = max(pc.mode(lengths, 1).to_pylist()[0]["mode"], 1)
    drawn = drawn.filter(pc.equal(lengths, dims))
    rows = rows.where(F.size("v") == dims)
    sample = np.concatenate([c.flatten().to_numpy() for c in drawn["v"].chunks]).reshape(-1, dims)
    index = fit_index(sample, rows.count(), k)
    del drawn, sample
    shared = spark.sparkContext.broadcast(index)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float32)

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                lists, codes = shared.value.encode(x)
                yield pa.record_batch([batch.column(0), pa.array(lists), *[pa.array([r.tobytes() for r in rs], pa.binary()) for rs in (codes, x)]], ["vec_id", "list", "codes", "x"])

    def asked_of(which: str):
        """Rows of queries and the lists they are asked of: the nearest one, the others that are probed, or all."""

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    lists = shared.value.probed(matrix(batch.column(2)))
                    lists = {"nearest": lists[:, :1], "others": lists[:, 1:], "all": np.tile(np.arange(len(shared.value.centers)), (len(lists), 1))}[which]
                    again = pa.array(np.repeat(np.arange(len(lists)), lists.shape[1]))
                    yield pa.record_batch([*[batch.column(i).take(again) for i in range(3)], pa.array(lists.ravel().astype(np.int32))], ["query_id", "floor", "v", "list"])

        return rows_of

    alike = Window.partitionBy("_h", "v").orderBy("vec_id")
    indexed = rows.select("vec_id", "v", F.xxhash64("v").alias("_h")).withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= most)
    coded = saved(indexed.select("vec_id", "v").mapInArrow(index_rows, "vec_id long, list int, codes binary, x binary"), "index")

    def scan(vecs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(vecs) or not len(qs):
            return pd.DataFrame({n: [] for n in names})
        ix = shared.value
        vecs = vecs.sort_values("vec_id")
        ids, number = vecs.vec_id.to_numpy(np.int64), int(vecs["list"].iloc[0])
        codes = np.frombuffer(b"".join(vecs.codes), np.uint8).reshape(len(vecs), -1)
        x = np.frombuffer(b"".join(vecs.x), np.float32).reshape(len(vecs), -1)
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(qs), 64):
            some = qs.iloc[at : at + 64]
            q = np.stack(some.v.to_numpy()).astype(np.float32)
            tables = ix.tables(q)
            for lo in range(0, len(ids), 16_384):
                part = codes[lo : lo + 16_384]
                scores = np.repeat((q @ ix.centers[number])[:, None], len(part), 1)
                for m in range(part.shape[1]):
                    scores += tables[:, m][:, part[:, m]]
                for qid, floor, row, asked_for in zip(some.query_id, some.floor, scores, q.astype(float), strict=True):
                    least = floor - ix.slack
                    if len(row) > most:  # the best from codes may all be overrated, and the others underrated
                        least = max(least, np.partition(row, -most)[-most] - 2 * ix.slack)
                    near = np.flatnonzero(row >= least)
                    # One after another, so that a score is the same wherever it is summed.
                    score = np.cumsum(x[lo + near].astype(float) * asked_for, axis=1)[:, -1]
                    good = np.flatnonzero(score >= floor)
                    best = good[_best(score[good], most)]
                    out[0].append(np.full(len(best), qid, np.int64))
                    out[1].append(ids[lo + near[best]])
                    out[2].append(score[best])
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, out, strict=True)})

    keys = ["list", "_cv", "_cq"]

    def search(queries: DataFrame, which: str) -> DataFrame:
        asked = queries.select("query_id", "floor", "v").mapInArrow(asked_of(which), "query_id long, floor double, v array<float>, list int")
        # Chunks of each list; a row for each of at most MOST_LISTS lists, so small enough to broadcast.
        parts = coded.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_VECTORS).cast("int").alias("_nv"))
        askers = asked.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("_nq"))
        parts = F.broadcast(parts.join(askers, "list"))
        left = (
            coded.join(parts, "list")
            .withColumns({"_cv": F.pmod(F.xxhash64("vec_id"), F.col("_nv")).cast("int"), "_cq": F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))})
            .select("list", "_cv", "_cq", "vec_id", "codes", "x")
        )
        right = (
            asked.join(parts, "list")
            .withColumns({"_cq": F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int"), "_cv": F.explode(F.sequence(F.lit(0), F.col("_nv") - 1))})
            .select("list", "_cv", "_cq", "query_id", "floor", "v")
        )
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")

    def best_of(found: DataFrame) -> DataFrame:
        """query_id and near: the best k + 1 in order; what does not belong there is dropped before rows meet."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
        return ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near"))

    asking = rows.where("q")
    once = asking.groupBy("v").agg(F.min("vec_id").alias("query_id")).withColumn("floor", F.lit(float("-inf")))
    once = saved(once.select("query_id", "floor", "v"), "queries")
    first = saved(search(once, "nearest"), "candidates")
    floors = best_of(first).where(F.size("near") == most).select("query_id", F.element_at("near", -1)["score"].alias("_f"))
    bounded = once.join(floors, "query_id", "left").withColumn("floor", F.coalesce("_f", "floor"))
    others = saved(search(bounded, "others"), "candidates")
    best = best_table = saved(best_of(first.union(others)), "best")
    short = once.join(best.where(F.size("near") == most), "query_id", "left_anti")
    if not short.isEmpty():
        best = best.join(short, "query_id", "left_anti").union(best_of(search(short, "all")))
    answers = asking.join(once.select("v", F.col("query_id").alias("_asked")), "v").select("vec_id", "_asked")
    answers = answers.join(best.select(F.col("query_id").alias("_asked"), "near"), "_asked")
    near = F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("vec_id")), 1, k)
    answers = answers.select(F.col("vec_id").alias("query_id"), F.posexplode(near).alias("_at", "_s"))
    out = saved(answers.select("query_id", (F.col("_at") + 1).alias("rank"), "_s.vec_id", "_s.score"), "neighbours")
    for table in (rows_table, coded, once, first, others, best_table):
        discard(table)
    return out
