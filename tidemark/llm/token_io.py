"""Token ids in Arrow stream files of fixed-size lists, with masks, readable without a copy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import modest_batches
from tidemark.llm.shingles import give_back
from tidemark.llm.tokens import encoder

SEQUENCE_LENGTH, BATCH_SEQUENCES = 2048, 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "path string, part int, n_docs long, n_tokens long"


def _sequence_schema(width: int, length: int) -> pa.Schema:
    kind = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])


class SequenceWriter:
    """Writes a stream of ids as batches of equal-length sequences; only the last is filled up, under a false mask.

    Ids are stored as unsigned 16-bit integers where the vocabulary allows it, else 32-bit.  Beside ``<path>`` a file
    ``<path>.index`` gives each document's first position and number of tokens.
    """

    def __init__(self, path: str, vocab_size: int, length: int):
        self.store, self.place = fs.FileSystem.from_uri(path)
        self.own = f"{self.place}.{uuid.uuid4().hex}"  # renamed when whole; a lost attempt leaves only this
        self.width, self.length = (2 if vocab_size <= 1 << 16 else 4), length
        self.store.create_dir(self.place.rpartition("/")[0], recursive=True)
        self.files = [self.store.open_output_stream(self.own), self.store.open_output_stream(f"{self.own}.index")]
        self.schema = _sequence_schema(self.width, length)
        self.ids = ipc.new_stream(self.files[0], self.schema)
        self.index = ipc.new_stream(self.files[1], INDEX)
        self.open, self.open_tokens, self.n_tokens, self.docs = [], 0, 0, []
        self.n_docs = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        found = np.frombuffer(ids, "<u4").astype(f"<u{self.width}")
        self.docs.append((doc_id, self.n_tokens, len(found)))
        self.open.append(found)
        self.n_tokens += len(found)
        self.open_tokens += len(found)
        self.n_docs += 1
        if self.open_tokens >= BATCH_SEQUENCES * self.length:
            self._write(False)

    def _write(self, last: bool) -> None:
        flat = np.concatenate(self.open) if self.open else np.empty(0, f"<u{self.width}")
        step = BATCH_SEQUENCES * self.length
        whole = len(flat) if last else len(flat) - len(flat) % step
        for at in range(0, whole, step):
            part = flat[at : min(whole, at + step)]
            n = -(-len(part) // self.length) * self.length
            mask = np.arange(n) < len(part)
            part = np.concatenate([part, np.zeros(n - len(part), part.dtype)])
            kinds = [f.type for f in self.schema]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=k) for x, k in zip((part, mask), kinds, strict=True)]
            self.ids.write_batch(pa.record_batch(lists, schema=self.schema))
        self.open, self.open_tokens = [flat[whole:]], len(flat) - whole
        if self.docs:
            self.index.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.docs, strict=True), INDEX, strict=True)], schema=INDEX))
            self.docs = []

    def close(self) -> None:
        self._write(True)
        self.ids.close()
        self.index.close()
        for f in self.files:
            f.close()
        for end in (".index", ""):  # the file of ids comes last: where it is, both are whole
            self._take_place(f"{self.own}{end}", f"{self.place}{end}")

    def _take_place(self, own: str, place: str) -> None:
        """Some stores do not rename onto a file that is there, as one is after a lost task; the same rows make the same file."""
        try:
            self.store.move(own, place)
        except OSError:
            if self.store.get_file_info(place).type == fs.FileType.NotFound:
                raise
            self.store.delete_file(place)
            self.store.move(own, place)


def documents_of(path: str, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(doc_id, start and n_tokens of some documents, their ids), one after another from the beginning of a file.

    Holds one batch of sequences and the ids of some documents at a time, whatever store the file is in.
    """
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_stream(place) as ids_file, store.open_input_stream(f"{place}.index") as index_file:
        batches, left = iter(ipc.open_stream(ids_file)), []

        def take(n: int) -> np.ndarray:
            out = []
            while n > 0:
                if not left:
                    left.append(next(batches).column(0).values.to_numpy(zero_copy_only=True))
                flat = left.pop()
                out.append(flat[:n])
                if len(flat) > n:
                    left.append(flat[n:])
                n -= len(out[-1])
            return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)

        for index in ipc.open_stream(index_file):
            for at in range(0, index.num_rows, rows):
                part = index.slice(at, rows)
                yield part, [take(n) for n in part.column(2).to_pylist()]


class SequenceFile:
    """Random access to a written file.  A local file is mapped, and ``sequence`` and ``mask`` copy nothing of the ids; one in
    another store is held in memory, so read it with ``documents_of`` where order is enough."""

    def __init__(self, path: str):
        store, place = fs.FileSystem.from_uri(path)
        opened = pa.memory_map if isinstance(store, fs.LocalFileSystem) else store.open_input_file
        self.batches = list(ipc.open_stream(opened(place)))
        self.index = ipc.open_stream(opened(f"{place}.index")).read_all()
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> np.ndarray:
        batch, row = self.batches[i // BATCH_SEQUENCES], i % BATCH_SEQUENCES
        return batch.column(0).values.to_numpy(zero_copy_only=True)[row * self.length : (row + 1) * self.length]

    def mask(self, i: int) -> pa.Array:
        batch, row = self.batches[i // BATCH_SEQUENCES], i % BATCH_SEQUENCES
        return batch.column(1).values.slice(row * self.length, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from a position on; only what spans two batches is copied."""
        step, out = BATCH_SEQUENCES * self.length, []
        while n > 0:
            flat = self.batches[start // step].column(0).values.to_numpy(zero_copy_only=True)
            out.append(flat[start % step : start % step + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)


def write_sequences(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int, length: int = SEQUENCE_LENGTH) -> list[tuple[str, int, int, int]]:
    """Encode all documents and write them in ascending doc_id order, a file for each range of ids.

    ``folder`` is a URI that every executor can write.  Returns the manifest, one (path, part, n_docs, n_tokens) for each
    file, in order; its length is the number of range partitions.  Documents with a null doc_id come first; ties are
    ordered by text; a null text is empty and gives the end id alone; an empty table gives no files.  A task writes under
    a name of its own and renames it when whole, so a task that runs twice leaves one whole file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), None
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        path = f"{folder.rstrip('/')}/part-{part:06d}.arrows"
        for batch in batches:
            if out is None and batch.num_rows:
                out = SequenceWriter(path, max(enc.vocab_size, end_id + 1), length)
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1)), strict=True):
                out.add(doc_id, ids + end)
        give_back()
        if out is not None:
            out.close()
            yield pa.record_batch([[path], pa.array([part], pa.int32()), [out.n_docs], [out.n_tokens]], ["path", "part", "n_docs", "n_tokens"])

    modest_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return sorted((tuple(r) for r in ordered.mapInArrow(write, MANIFEST).collect()), key=lambda r: r[1])


def read_documents(spark: SparkSession, manifest: list[tuple[str, int, int, int]]) -> DataFrame:
    """doc_id, start (position in the order of all files), n_tokens and ids (unsigned 32-bit, little-endian), from the files."""
    rows, start = [], 0
    for path, _, _, n_tokens in manifest:
        rows.append((path, start))
        start += n_tokens
    files = spark.createDataFrame(rows, "path string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part, found in documents_of(path):
                    ids = pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())
                    yield pa.record_batch([part.column(0), pc.add(part.column(1), first), part.column(2), ids], names)

    return files.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")

