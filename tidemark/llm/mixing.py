"""Mixing sources to target weights, with DataFrame functions alone.

The words of a source, document after document, are cut into blocks of a fixed number of words.  The output is a row of
slots, a block each, in shards of a fixed number of slots.  How many slots of a shard go to each source is a multinomial draw;
running sums of these counts number a source's slots through, and a pseudorandom permutation of the source's block indices
turns the number into the block that is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved, small

BLOCK_WORDS, SHARD_SLOTS = 128, 4096
#: Documents of one source that one window over positions should hold, and rows of a table of running sums.
BUCKET_ROWS, RUN_ROWS = 5_000, 4_096
#: A source with a target of less than so many blocks is cut into so many smaller ones.
LEAST_BLOCKS = 16
#: Rounds of an index permutation, and slots that one task numbers.
ROUNDS, TASK_SLOTS = 24, 1 << 16


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Adds ``rank``, ``source_size`` and ``target`` to a table of ``source`` and ``source_size``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes; none gets more than
    ``cap`` times its own size, and the excess is shared again by weight.  The level where that settles is found in one
    pass over the sources by the size each can take for its weight.  One row a source; this step runs in one task.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"_weight": weight, "_most": F.col("source_size") * F.lit(float(cap))})
    by_room = everything.orderBy(F.col("_most") / F.col("_weight"), "rank")
    ahead = by_room.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_room.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn(
        "_level",
        (F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("_most").over(ahead), F.lit(0.0)))
        / F.sum("_weight").over(behind),
    )
    settled = F.max(F.when(F.col("_most") >= F.col("_level") * F.col("_weight"), F.col("_level"))).over(everything)
    return ranked.withColumn("target", F.least("_most", F.coalesce(settled, F.lit(0.0)) * F.col("_weight"))).drop("_weight", "_most", "_level")


def _permuted(index: Column, n: Column, salt: Column) -> Column:
    """A keyed one-to-one map of 0..n-1 onto itself: a swap-or-not shuffle, which fits any n.

    In each round an index and its mirror image change places or not, as a hash of the larger of them says.
    """

    def swap(x: Column, i: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(salt, i), n) - x, n)
        return F.when(F.xxhash64(salt, i, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(F.lit(list(range(ROUNDS))), index.cast("long"), swap)


def _running(df: DataFrame, by: str, at: str, n: str, out: str) -> DataFrame:
    """Adds the sum of ``n`` over the rows of the same ``by`` with a smaller ``at`` (0, 1, ...), in two levels, so that no window holds
    much more than RUN_ROWS rows where ``by`` has a row for each ``at``."""
    df = df.withColumn("_run", F.floor(F.col(at) / RUN_ROWS))
    ahead = Window.partitionBy(by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = df.groupBy(by, "_run").agg(F.sum(n).alias("_in_run"))
    runs = runs.withColumn("_before", F.coalesce(F.sum("_in_run").over(ahead), F.lit(0))).drop("_in_run")
    inside = Window.partitionBy(by, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    joined = _null_safe_join(df, runs, [by, "_run"])
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("_run", "_before")


def mix_sources(
    docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), cap: float = 3, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
    seed: int = 0, columns: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of a mixture of ``docs`` (``doc_id``, ``source``, ``text``; others are kept as they are).

    documents: the input's rows (``columns`` of them, if given) with ``row_id``, ``size`` (words), ``source_size`` and
    ``target`` (the source's words to take).  pieces: one row for each stretch of a document in an output block: ``shard``,
    ``slot`` (in the whole output), ``row_id``, ``first_word``, ``n_words``.

    Every source's blocks are taken equally often, up to one time, in as many rounds as its target asks for; a round is an
    index permutation of its own.  Each shard's counts by source are a multinomial draw by targets; the draws by which a
    source's total over all shards comes out above its target's slots go to the sources that come out below.  No block comes
    more than ``cap`` times.  A source with a target of under LEAST_BLOCKS blocks is cut into smaller blocks.

    A null text has no words and no pieces; null is a source of its own; repeated rows are documents of their own, told
    apart by row_id; an empty table gives two empty ones.  Input columns named like the added ones are replaced.  A source
    of any size is spread over buckets of rows, and its blocks over tasks by index.  Positions depend on doc_ids and texts
    alone, but for rows without a doc_id, and rows that repeat both.  The texts are read once; the results rest on tables in
    the shared folder.
    """
    added = ("row_id", "size", "source_size", "target")
    docs = docs.drop(*[c for c in added if c in docs.columns])
    kept = list(docs.columns if columns is None else columns)
    own = [F.monotonically_increasing_id().alias("row_id"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_hash")]
    base = saved(docs.select(*kept, *[c for c in ("doc_id", "source") if c not in kept], *own), "documents")
    buckets = max(1, -(-base.count() // BUCKET_ROWS))
    nameless = F.when(F.col("doc_id").isNull(), F.col("row_id"))
    slim = base.select("row_id", "doc_id", "source", "size", "_hash", F.pmod(F.xxhash64("doc_id", "_hash", nameless, F.lit(seed)), F.lit(buckets)).alias("_bucket"))
    parts = _running(slim.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")), "source", "_bucket", "_words", "_ahead")

    src = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    src = src.withColumn("_width", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / LEAST_BLOCKS))).cast("long"))
    n_blocks = F.ceil(F.col("source_size") / F.col("_width"))
    slots = F.when(F.col("source_size") > 0, F.least(n_blocks * F.floor(F.lit(cap)), F.round(F.col("target") * n_blocks / F.col("source_size")))).otherwise(0)
    src = saved(src.withColumns({"_blocks": n_blocks, "_slots": slots.cast("long")}), "sources")

    # Where each document's words lie in its source.
    window = Window.partitionBy("source", "_bucket").orderBy("doc_id", "_hash", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    positions = slim.where("size > 0").withColumn("_end", F.sum("size").over(window))
    positions = _null_safe_join(positions, parts.select("source", "_bucket", "_ahead"), ["source", "_bucket"])
    positions = _null_safe_join(positions, small(src.select("source", "rank", "_width")), ["source"])
    positions = positions.withColumns({"_last": F.col("_ahead") + F.col("_end") - 1, "_first": F.col("_ahead") + F.col("_end") - F.col("size")})
    touched = positions.select(
        "rank", "row_id", "_first", "_last", "_width", F.explode(F.sequence(F.floor(F.col("_first") / F.col("_width")), F.floor(F.col("_last") / F.col("_width")))).alias("block")
    )
    low, high = F.greatest("_first", F.col("block") * F.col("_width")), F.least("_last", F.col("block") * F.col("_width") + F.col("_width") - 1)
    touched = touched.select("rank", "block", "row_id", (low - F.col("_first")).alias("first_word"), (high - low + 1).alias("n_words"))

    documents = _null_safe_join(base, small(src.select("source", "source_size", "target")), ["source"])
    pieces = _slots(src, shard_slots, seed).join(touched, ["rank", "block"])
    return documents.select(*kept, *added), pieces.select("shard", "slot", "row_id", "first_word", "n_words")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which a null source meets the null source."""
    right = right.withColumnsRenamed({k: f"_{k}_r" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}_r")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond).drop(*[f"_{k}_r" for k in keys])


def shard_counts(src: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, rank and n: a multinomial draw of ``shard_slots`` slots (the last shard: what is left of ``total``) for each shard, with
    chances by ``_slots``."""
    spans = _spans(src, "_slots", "_from", total)
    x = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(max(1, total)))
    draws = src.sparkSession.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), x.alias("_x"))
    return _falls(draws, "_x", spans, total).groupBy("shard", "rank").agg(F.count("*").alias("n"))


def _slots(src: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """shard, slot, rank and block of every slot of the output."""
    total = src.agg(F.coalesce(F.sum("_slots"), F.lit(0))).first()[0]
    counts = saved(shard_counts(src, total, shard_slots, seed), "counts")
    ledger = src.select("rank", "_slots", "_blocks").join(counts.groupBy("rank").agg(F.sum("n").alias("_drawn")), "rank", "left")
    ledger = ledger.withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    ledger = ledger.withColumns({"_over": F.greatest(F.col("_drawn") - F.col("_slots"), F.lit(0)), "_under": F.greatest(F.col("_slots") - F.col("_drawn"), F.lit(0))})
    ahead = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    ledger = saved(ledger.withColumn("_over_from", F.coalesce(F.sum("_over").over(ahead), F.lit(0))), "ledger")

    counts = _running(counts, "rank", "shard", "n", "_base")
    in_shard = Window.partitionBy("shard")
    counts = counts.withColumns(
        {"_place": F.sum("n").over(in_shard.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "_size": F.sum("n").over(in_shard)}
    )
    # A few rows become very many, so they are spread by hand.
    tasks = max(1, min(-(-total // TASK_SLOTS), 32_768))
    each = counts.join(small(ledger), "rank").repartition(tasks, "shard").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    place = _permuted(F.col("_place") + F.col("_i"), F.col("_size"), F.xxhash64("shard", F.lit(seed + 3)))
    each = each.select("shard", (F.col("shard") * shard_slots + place).alias("slot"), "rank", "_slots", "_blocks", "_over_from", (F.col("_base") + F.col("_i")).alias("_nth"))
    kept = each.where("_nth < _slots").select("shard", "slot", "rank", "_blocks", "_nth")
    # Draws above a source's slots, numbered through, fill up the sources that were drawn too rarely.
    over = each.where("_nth >= _slots").select("shard", "slot", (F.col("_over_from") + F.col("_nth") - F.col("_slots")).alias("_x"))
    short = ledger.agg(F.coalesce(F.sum("_under"), F.lit(0))).first()[0]
    moved = _falls(over, "_x", _spans(ledger, "_under", "_from", short, "_blocks", "_drawn"), short)
    moved = moved.select("shard", "slot", "rank", "_blocks", (F.col("_drawn") + F.col("_x") - F.col("_from")).alias("_nth"))
    out = kept.union(moved)
    turn = F.floor(F.col("_nth") / F.col("_blocks"))
    block = _permuted(F.col("_nth") % F.col("_blocks"), F.col("_blocks"), F.xxhash64("rank", turn, F.lit(seed + 2)))
    return out.select("shard", "slot", "rank", block.alias("block"))


def _span_width(total: int) -> int:
    return max(1 << 14, total >> 18)


def _spans(sources: DataFrame, n: str, start: str, total: int, *more: str) -> DataFrame:
    """A stretch of ``n`` numbers for each source, one after another, cut at fixed widths: rank, start, n, the span, and more columns."""
    width = _span_width(total)
    ahead = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    rows = sources.withColumn(start, F.coalesce(F.sum(n).over(ahead), F.lit(0))).where(F.col(n) > 0)
    cut = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(start) + F.col(n) - 1) / width)))
    return small(rows.select("rank", F.col(start), F.col(n).alias("_n"), cut.alias("_span"), *more))


def _falls(rows: DataFrame, x: str, spans: DataFrame, total: int) -> DataFrame:
    """Each row with the source in whose stretch its number lies: a range join by spans of fixed width."""
    rows = rows.withColumn("_span", F.floor(F.col(x) / _span_width(total)))
    return rows.join(spans, "_span").where((F.col(x) >= F.col("_from")) & (F.col(x) < F.col("_from") + F.col("_n")))


def mixed_texts(documents: DataFrame, pieces: DataFrame, *, text: str = "text") -> DataFrame:
    """The pieces with their documents' columns and, as ``text``, a stretch of their words with the white
    space between them and behind them.

    ``documents`` has row_id and the whole texts as column ``text``.  Each text is split once and all its pieces are cut from
    it, so it moves once however many pieces it has.
    """
    spots = pieces.groupBy("row_id").agg(F.collect_list(F.struct("shard", "slot", "first_word", "n_words")).alias("_spots"))
    joined = documents.join(spots, "row_id")
    words = F.regexp_extract_all(F.col(text), F.lit(r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), 0)
    joined = joined.withColumn("_words", words).drop(text)
    cut = F.transform(
        "_spots",
        lambda s: s.withField("text", F.array_join(F.slice("_words", (s["first_word"] + 1).cast("int"), s["n_words"].cast("int")), "")),
    )
    return joined.withColumn("_piece", F.explode(cut)).select("*", "_piece.*").drop("_spots", "_words", "_piece")
