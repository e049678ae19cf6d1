"""Near-duplicate documents by the Jaccard similarity of their word shingles: a parity-sketch join.

A sketch has one bit for each hash value; every shingle flips its bit.  Two sketches differ in no more bits than the two sets
differ in shingles.  For similarity t and set sizes a and b that is (1 - t) / (1 + t) * (a + b) at most, so if a sketch is cut
into more words than that, some are equal in both.  A word is kept as the exclusive or of its set bits' numbers, as so wide a
sketch is nearly empty.  Sketches of one band of sizes have the same number of words; a document is filed under as many of
its words as its allowance plus two.  As every document takes words in the same order, two similar documents share two filed
words (a prefix filter on the pigeonhole).  Where very many documents are filed under a word, they are dealt on by each
second word that follows it, so only those meet that share both.  The order takes words of many shingles first that are not
common, as counted over all documents, so few unlike documents meet; it has no influence on the result.  Of documents that share one, those whose
narrower sketches differ in more bits than allowed are told apart at once; the others are verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, discard, modest_batches, rows_of, saved, small
from tidemark.llm.shingles import give_back, mix, shingle_sets

#: Sets of one block when all documents under a filed word are compared with each other, and blocks beyond which fewer rows are dealt
#: out if the word's sets are dealt on by second words (a set has some tens of these).
BLOCK, MOST_BLOCKS = 512, 32
#: A shingle is common in so many of so many documents, so many at least; bits of a hash under which shingles are counted (one that
#: shares them with others is counted with these, by every document alike), times the average that a count must reach, and
#: counts of a slice of the table.
COMMON_FROM, COMMON_OF, COMMON_BITS, COMMON_LOAD, COMMON_SLICE = 3, 8_000, 22, 3, 1 << 16
#: Sets of which a task remembers that it has filed them already.
REMEMBERED = 500_000


def allowance(n: int, percent: int) -> int:
    """Shingles in which a set of n and any set similar to it can differ at most."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def bands(n: int, percent: int) -> list[int]:
    """The bands of a set of n: its own, and the next where a larger partner may lie."""
    own = n.bit_length() - 1
    return [own, own + 1] if 100 * n // percent >= 1 << (own + 1) else [own]


def _word_ends(h: np.ndarray, words: int) -> np.ndarray:
    """Where the hashes of each word begin in sorted hashes, and the end."""
    word = ((h >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)
    return np.searchsorted(word, np.arange(words + 1, dtype=np.uint64))


def sketch(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words of the wide parity sketch of sorted hashes, each as the exclusive or of its set bits' numbers, scrambled."""
    flips = np.bitwise_xor.accumulate(np.concatenate([np.zeros(1, np.uint64), mix(h + np.uint64(0xA24BAED4963EE407))]))
    return flips[ends[1:]] ^ flips[ends[:-1]]


def filed_words(h: np.ndarray, percent: int, common: np.ndarray) -> list[np.ndarray]:
    """Keys under which a set is filed, in order, for each of its bands; none if only an equal set can be similar.

    ``common`` has a byte for eight hash prefixes.  What decides a key's place are the shingles behind it alone, so any two
    sets have the keys that they share in the same order.
    """
    allowed = allowance(len(h), percent)
    if allowed == 0:
        return []
    prefix = h >> np.uint64(64 - COMMON_BITS)
    rare = (common[prefix >> np.uint64(3)] >> (prefix & np.uint64(7)).astype(np.uint8)) & 1 == 0
    so_far = np.concatenate([[0], np.cumsum(rare)])
    out = []
    for band in bands(len(h), percent):
        words = allowance(1 << (band + 1), percent) * 11 // 10 + 2
        ends = _word_ends(h, words)
        found = sketch(h, ends)
        keys = mix(mix(found) + np.arange(words, dtype=np.uint64) * np.uint64(128) + np.uint64(band))
        # What a word's shingles are decides its place: how many are rare, how many there are, and its key.
        merit = (np.minimum(np.diff(so_far[ends]), 63) * 128 + np.minimum(np.diff(ends), 127)).astype(np.uint64)
        order = ((np.uint64(8191) - merit) << np.uint64(50)) | (keys >> np.uint64(14))
        first = np.argpartition(order, allowed + 1)[: allowed + 2] if allowed + 2 < words else np.arange(words)
        out.append(keys[first[np.argsort(order[first], kind="stable")]])
    return out


def long_sketch(h: np.ndarray) -> bytes:
    """A parity sketch of four to eight bits a shingle, a power of two; half of it over the other half is the next shorter."""
    bits = max(64, 4 << (len(h) - 1).bit_length())
    slots = h & np.uint64(bits - 1)
    slots.sort()
    odd = np.unique(slots, return_counts=True)
    flat = np.zeros(bits, np.uint8)
    flat[odd[0][odd[1] % 2 == 1].astype(np.int64)] = 1
    return np.packbits(flat).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches, brought to the length of the shortest, as rows of 64-bit words."""
    size = min(map(len, sketches))
    out = np.empty((len(sketches), size // 8), np.uint64)
    for i, sketch in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def may_be_similar(x: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the others, by their sketches and sizes, can be similar to x; bits by which each stays within its allowance)."""
    slack = (100 - percent) * (n + sizes) // (100 + percent) - np.bitwise_count(others ^ x).sum(axis=1, dtype=np.int64)
    return (slack >= 0) & (100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)), slack


def set_id(h: np.ndarray) -> int:
    """A positive 63-bit id of a set of hashes."""
    total = (int(h.sum(dtype=np.uint64)) + len(h) * 0xD6E8FEB86659FD93) % (1 << 64)
    return int(mix(np.array([total], np.uint64))[0]) >> 1


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """One row a document: doc_id, n_shingles, set (id of its set of shingles) and component_id.

    Documents are linked when their sets are equal or their Jaccard similarity is ``percent`` hundredths or more, counted on
    the sets; component_id is the smallest doc_id that links reach.  Shingles and sets are told apart by 64-bit hashes.  Equal
    sets are one node, so copies are never compared.  A filed word's first set is compared with all others under it.  Where
    components of those links still meet under a word, all of its sets are compared by their sketches, and a spanning forest
    of the possible links is verified; if one of its pairs fails, the cluster of possible links is compared on the sets.  Sets
    of one word are compared in blocks of BLOCK by BLOCK; a word of more than MOST_BLOCKS blocks is first split by second
    words.  So no group is held whole and no component is lost.

    A text without words, or null, has no shingles, no links and component_id doc_id.  A null doc_id stays null, links like
    any other, and counts for no component's smallest, which is null if there is no other; rows that repeat a doc_id are
    documents of their own; an empty table gives an empty result; other columns are ignored.  The result rests on a small
    table in the shared folder.
    """

    modest_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("own"))
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, words, lower))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            rows: list[list] = [[], [], [], []]
            for h in shingle_sets(batch.column(1), words, lower):
                own = set_id(h) if len(h) else None
                new = own is not None and own not in seen
                if new:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(own)
                keys = [k.view(np.int64) for k in filed_words(h, percent, common.value)] if new else []
                for column, x in zip(rows, (len(h), own, keys, long_sketch(h) if len(keys) else None), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            columns = [batch.column(0), batch.column(2), *[pa.array(c, t) for c, t in zip(rows, types, strict=True)]]
            yield pa.record_batch(columns, ["doc_id", "own", "n", "c", "keys", "sketch"])
        give_back()

    described = saved(docs.mapInArrow(describe, "doc_id long, own long, n long, c long, keys array<array<long>>, sketch binary"), "sketches")
    filed = described.where("size(keys) > 0").select(F.explode(F.flatten("keys")).alias("key"), "c")
    # Filed rows are shuffled once: what shares a word with another set is told apart where the word's rows lie together.
    word = Window.partitionBy("key")
    shared = filed.withColumns({"a": F.min("c").over(word), "z": F.max("c").over(word)}).where("a <> z")
    shared = saved(shared.select("key", "c", "a").distinct(), "words")
    stars = saved(shared.where("a <> c").select("a", F.col("c").alias("b")).distinct(), "stars")
    members = small(saved(stars.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "members"))
    # One row a set: copies of a text that tasks met apart have the same sketch.
    sketches = described.where("sketch is not null").select("c", F.col("n").cast("int").alias("n"), "sketch")
    sketches = saved(sketches.join(members, "c").groupBy("c").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch")), "long")
    pairs = saved(_passing(stars, sketches, percent), "pairs")
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), 2 * rows_of(pairs), docs, described, words, lower)
    links = saved(_verified(pairs, sets, percent), "links")
    found = connected_components(links)

    # Filed words under which more than one component is left, and more than the pair that was compared.
    rest = saved(_open(shared.select("key", "c"), found), "rest")
    few, many = (rest.where(c) for c in (F.col("sets") <= BLOCK * MOST_BLOCKS, F.col("sets") > BLOCK * MOST_BLOCKS))
    if not many.isEmpty():
        # Two similar sets share a second word behind the first one that they share.
        bands = described.where("size(keys) > 0").join(small(many.select("c").distinct()), "c").select("c", F.explode("keys").alias("band"))
        behind = F.explode(F.slice("band", (F.array_position("band", F.col("key")) + 1).cast("int"), F.size("band")))
        second = bands.join(many.select("key", "c"), "c").where(F.array_contains("band", F.col("key"))).select("c", "key", behind.alias("second"))
        second = second.select("c", F.xxhash64("key", "second").alias("key")).distinct()
        few = few.union(_open(second, found, pairs_too=True))
    more = saved(_compared(few.select("key", "c", "m"), sketches, percent).distinct(), "pairs")
    more_sets = _sets(more.select(F.explode(F.array("a", "b")).alias("c")).distinct(), 2 * rows_of(more), docs, described, words, lower)
    more_links = saved(_verified(more, more_sets, percent), "links")
    before, found = found, _joined(found, more_links)

    # Where a pair of a spanning forest failed, its whole cluster of possible links is compared exactly.
    failed = saved(more.join(more_links, ["a", "b"], "left_anti"), "failed")
    spent = [described, shared, stars, sketches, pairs, links, rest, more, more_links, sets, more_sets, before, failed]
    if rows_of(failed):
        clusters = _joined(found, more).toDF("c", "cluster")
        hard = failed.join(clusters.withColumnRenamed("c", "a"), "a").select("cluster").distinct()
        inside = clusters.join(small(hard), "cluster").join(found.withColumnRenamed("node", "c"), "c", "left").select("cluster", "c", F.coalesce("component", "c").alias("m"))
        inside = saved(inside, "inside")
        hard_sets = _sets(inside.select("c").distinct(), rows_of(inside), docs, described, words, lower)
        hard_links = saved(_exact(inside, hard_sets, percent), "links")
        spent += [found, inside, hard_sets, hard_links]
        found = _joined(found, hard_links)

    # The smallest doc_id of each set, then of each component, and back; what has very many rows is only ever joined with a table.
    lowest = saved(described.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("low")), "lowest")
    linked = saved(lowest.join(small(found.withColumnRenamed("node", "c"), rows=rows_of(found)), "c"), "linked")
    roots = saved(linked.groupBy("component").agg(F.min("low").alias("component_id")), "roots")
    linked_ids = linked.join(small(roots), "component").select("c", "component_id")
    single = lowest.join(small(linked.select("c"), rows=rows_of(linked)), "c", "left_anti").select("c", F.col("low").alias("component_id"))
    labels = saved(single.union(linked_ids), "labels")
    out = described.select("doc_id", "n", "c").join(labels, "c", "left")
    out = out.withColumn("component_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    out = saved(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("set"), "component_id"), "components")
    for table in (*spent, found, lowest, linked, roots, labels):
        discard(table)
    return out


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links; each has two nodes at least, so links to its smallest tell it."""
    return connected_components(found.where("node <> component").toDF("a", "b").union(links)) if rows_of(links) else found


def _open(filed: DataFrame, found: DataFrame, pairs_too: bool = False) -> DataFrame:
    """key, c, m (the set's component so far) and sets (how many the key has), of keys of more than one component; without
    ``pairs_too``, of more than two sets, as the two were compared already."""
    labelled = filed.join(small(found.withColumnRenamed("node", "c"), rows=rows_of(found)), "c", "left").select("key", "c", F.coalesce("component", "c").alias("m"))
    labelled = saved(labelled, "labelled")
    per_key = labelled.groupBy("key").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count("*").alias("sets"))
    per_key = per_key.where("lo <> hi" if pairs_too else "lo <> hi and sets > 2").select("key", "sets")
    return labelled.join(small(saved(per_key, "open")), "key").select("key", "c", "m", "sets")


def _common(docs: DataFrame, words: int, lower: bool) -> np.ndarray:
    """A table of 2**COMMON_BITS bits: the hash prefixes of shingles that are common among all documents.

    Every shingle of every text is counted under its prefix; a text that a task meets again is not.  A prefix is common from
    COMMON_FROM in COMMON_OF rows on, and from COMMON_LOAD times what a prefix has on average.  Each task counts into a table of
    fixed size, and the tables are added slice by slice.
    """
    rows = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        totals = np.zeros(1 << COMMON_BITS, np.int32)
        for batch in batches:
            for h in shingle_sets(batch.column(0), words, lower):
                if len(h) and (own := set_id(h)) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(own)
                    np.add.at(totals, (h >> np.uint64(64 - COMMON_BITS)).view(np.int64), 1)
        for number, part in enumerate(totals.reshape(-1, COMMON_SLICE)):
            if part.any():
                kind = next(k for k in (np.uint8, np.uint16, np.int32) if part.max() <= np.iinfo(k).max)
                counts = pa.array([part.astype(kind).tobytes()], pa.binary())
                yield pa.record_batch([pa.array([number], pa.int32()), pa.array([int(part.sum(dtype=np.int64))]), counts], ["slice", "n", "counts"])
        del totals
        give_back()

    counted = saved(docs.select("text").mapInArrow(count, "slice int, n long, counts binary"), "counts", F.sum("n"))
    least = max(COMMON_FROM, -(-rows * COMMON_FROM // COMMON_OF), COMMON_LOAD * (counted._mark or 0) // (1 << COMMON_BITS))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = {1: np.uint8, 2: np.uint16, 4: np.int32}[len(part) // COMMON_SLICE]
                totals.setdefault(number, np.zeros(COMMON_SLICE, np.int64))[:] += np.frombuffer(part, kind)
        for number, total in totals.items():
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([bits], pa.binary())], ["slice", "bits"])

    table = np.zeros(((1 << COMMON_BITS) // COMMON_SLICE, COMMON_SLICE // 8), np.uint8)
    for number, bits in counted.select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, bits binary").collect():
        table[number] = np.frombuffer(bits, np.uint8)
    discard(counted)
    return table.reshape(-1)


def _passing(stars: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow for similarity."""
    for side in ("a", "b"):
        stars = stars.join(sketches.select(F.col("c").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for na, nb, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                both = folded([x, y])
                good.append(bool(may_be_similar(both[0], both[1:], na, np.array([nb]), percent)[0][0]))
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return stars.where(fits).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(check, "a long, b long")


def _sets(members: DataFrame, rows: int, docs: DataFrame, described: DataFrame, words: int, lower: bool) -> DataFrame:
    """c and hashes (binary) of each member set (``rows`` at most), from one document that has it, whether or not it has a doc_id."""
    chosen = described.join(small(members, rows=rows), "c").groupBy("c").agg(F.min("own").alias("own"))
    chosen = small(saved(chosen, "chosen"))
    texts = docs.select("own", "text").join(chosen, "own")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) >= REMEMBERED:
                seen.clear()
            batch = batch.filter(pa.array([c not in seen for c in batch.column(1).to_pylist()], pa.bool_()))
            ids = batch.column(1).to_pylist()
            kept = [(c, h.tobytes()) for c, h in zip(ids, shingle_sets(batch.column(0), words, lower), strict=True) if len(h) and set_id(h) == c]
            if kept:
                seen.update(c for c, _ in kept)
                yield pa.record_batch([pa.array([c for c, _ in kept], pa.int64()), pa.array([h for _, h in kept], pa.binary())], ["c", "hashes"])
        give_back()

    return saved(texts.select("text", "c").mapInArrow(hashes, "c long, hashes binary").dropDuplicates(["c"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, counted on the sets."""
    joined = pairs
    for side in ("b", "a"):
        joined = joined.join(sets.select(F.col("c").alias(side), F.col("hashes").alias(f"h{side}")), side)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(*(np.frombuffer(batch.column(i)[k].as_buffer(), np.uint64) for i in (2, 3)), percent) for k in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        give_back()

    return joined.select("a", "b", "ha", "hb").mapInArrow(check, "a long, b long").distinct()


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Adds _block, and a row for each pair (i, j) of blocks of the key that a row's block is in, so that any two rows of a
    key meet in a bounded group, those of one block where i = j."""
    rows = rows.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(key).orderBy("c")) - 1) / BLOCK).cast("int"))
    rows = rows.withColumn("_blocks", F.max("_block").over(Window.partitionBy(key)) + 1)
    pair = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, "_block").alias("i"), F.greatest(o, "_block").alias("j")))
    return rows.withColumn("_ij", F.explode(pair)).select("*", "_ij.i", "_ij.j").drop("_ij", "_blocks")


class _Forest:
    """Which components have been joined so far in a group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def _compared(rest: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the sets under one key, a spanning forest between components of the pairs whose sketches allow for similarity.

    The pairs with the fewest differing bits come first.  A group gives fewer pairs than it has rows.
    """
    dealt = _in_blocks(rest, "key").join(sketches, "c").select("key", "i", "j", "c", "m", "n", "_block", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            _, i, j = group[0][:3]
            c, m, n, block = (np.array([row[k] for row in group], np.int64) for k in range(3, 7))
            rows = folded([row[7] for row in group])
            out: list[tuple[int, int, int]] = []
            for x in range(len(group) - 1):
                good, slack = may_be_similar(rows[x], rows[x + 1 :], int(n[x]), n[x + 1 :], percent)
                good &= m[x] != m[x + 1 :]
                if i != j:
                    good &= block[x] != block[x + 1 :]
                good = np.flatnonzero(good)
                if len(good):  # for each other component the likeliest
                    good = good[np.argsort(-slack[good], kind="stable")]
                    good = good[np.unique(m[x + 1 :][good], return_index=True)[1]]
                    out += [(-int(slack[y]), x, x + 1 + int(y)) for y in good]
            forest = _Forest()
            found = [(min(c[x], c[y]), max(c[x], c[y])) for _, x, y in sorted(out) if forest.join(int(m[x]), int(m[y]))]
            if found:
                yield pa.record_batch([pa.array(side, pa.int64()) for side in zip(*found, strict=True)], ["a", "b"])
        give_back()

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long")


def _exact(inside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the sets of one cluster, a spanning forest between components of the pairs that are similar, counted on the sets."""
    dealt = _in_blocks(inside, "cluster").join(sets, "c").select("cluster", "i", "j", "c", "m", "_block", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            _, i, j = group[0][:3]
            c, m, block = ([row[k] for row in group] for k in range(3, 6))
            own = [np.frombuffer(row[6], np.uint64) for row in group]
            n = np.array([len(h) for h in own])
            rows, forest, found = folded([long_sketch(h) for h in own]), _Forest(), []
            for x in range(len(group) - 1):
                good, slack = may_be_similar(rows[x], rows[x + 1 :], int(n[x]), n[x + 1 :], percent)
                good = np.flatnonzero(good)
                for y in (x + 1 + good[np.argsort(-slack[good], kind="stable")]).tolist():
                    if (i == j or block[x] != block[y]) and forest.find(m[x]) != forest.find(m[y]) and similar(own[x], own[y], percent):
                        forest.join(m[x], m[y])
                        found.append((min(c[x], c[y]), max(c[x], c[y])))
            if found:
                yield pa.record_batch([pa.array(side, pa.int64()) for side in zip(*found, strict=True)], ["a", "b"])
        give_back()

    return dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(compare, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows with the same first columns, which come one after another."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield held
                now, held = row[:keys], []
            held.append(row)
    if held:
        yield held
