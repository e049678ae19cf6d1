"""Packing of token sequences: first-fit decreasing on a tournament tree, in randomised groups of documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import modest_batches
from tidemark.llm.shingles import give_back
from tidemark.llm.tokens import encoder

SEQUENCE_LENGTH, GROUP_DOCS = 2048, 2048
#: Bytes of the documents' ends that a task holds before it packs them, though the group goes on.
HELD_BYTES = 32 << 20
#: Bytes of texts that are encoded together, and of ids that leave together.
AT_ONCE = 1 << 20


class BinTree:
    """A tournament tree over the free room of bins: each inner node holds the larger room of its two sides."""

    def __init__(self, room: int, most_bins: int):
        self.room, self.used = room, 0
        self.leaves = 1 << max(0, (most_bins - 1).bit_length())
        self.best = [room] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, room used in it before) of the first bin with enough room."""
        best, node = self.best, 1
        if best[1] < length:
            raise ValueError("longer than a bin, or no bin is left")
        while node < self.leaves:
            node *= 2
            if best[node] < length:
                node += 1
        found, before = node - self.leaves, self.room - best[node]
        best[node] -= length
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        self.used = max(self.used, found + 1)
        return found, before


def first_fit_decreasing(lengths: Sequence[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) for each length, longest first; equally long ones in the order given."""
    tree = BinTree(room, max(1, len(lengths)))
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = tree.place(lengths[i])
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Packer:
    """Takes the documents of one group in turn.  Full pieces leave at once as sequences of their own; the ends are held, under 4 *
    ``room`` bytes each, and packed together when the group ends, or when they come to HELD_BYTES."""

    def __init__(self, group: int, room: int):
        self.sequence, self.room, self.ends, self.held = group << 32, room, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n, room = len(ids) // 4, self.room
        whole = n - n % room
        for start in range(0, whole, room):
            yield doc_id, start, room, ids[4 * start : 4 * (start + room)], n, self.sequence, 0
            self.sequence += 1
        if n % room:
            self.ends.append((doc_id, whole, n % room, ids[4 * whole :], n))
            self.held += 4 * (n % room)
            if self.held >= HELD_BYTES:
                yield from self.close()

    def close(self) -> Iterator[tuple]:
        used = 0
        for end, (found, offset) in zip(self.ends, first_fit_decreasing([e[2] for e in self.ends], self.room), strict=True):
            used = max(used, found + 1)
            yield *end, self.sequence + found, offset
        self.sequence, self.ends, self.held = self.sequence + used, [], 0


def pack_documents(
    docs: DataFrame, tokenizer: str, *, end_id: int = 1, sequence_length: int = SEQUENCE_LENGTH, group_docs: int = GROUP_DOCS, seed: int = 0
) -> DataFrame:
    """Pieces of documents packed into sequences of at most ``sequence_length`` tokens.

    Each document (``doc_id``, ``text``) is encoded and gets ``end_id``.  Documents are dealt to randomised groups of about
    ``group_docs``; a group is packed in one pass by a task, which holds no more than the documents' ends, so a lost task
    is redone alone.  Pieces of full length make sequences of their own; what is left of each document is packed first-fit
    decreasing.  Rows: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null text is empty (one piece with the end id); a null doc_id stays null; repeated rows are packed each on its own;
    an empty table gives no pieces; other columns are ignored.
    """
    modest_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(groups)).alias("_group"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def pieces() -> Iterator[tuple]:
            now, packer = None, None
            for batch in batches:
                ids, group = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                for doc_id, encoded, g in zip(ids, enc.encode_many(batch.column(1), AT_ONCE), group, strict=True):
                    if g != now:
                        if packer:
                            yield from packer.close()
                        now, packer = g, _Packer(g, sequence_length)
                    yield from packer.add(doc_id, encoded + end)
            if packer:
                yield from packer.close()

        rows, size = [], 0
        for row in pieces():
            rows.append(row)
            size += len(row[3])
            if size > AT_ONCE:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)
        give_back()

    return dealt.repartition("_group").sortWithinPartitions("_group", "doc_id").mapInArrow(pack, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
