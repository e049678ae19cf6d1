"""Long repeated passages, found on enhanced suffix arrays and removed wherever they occur.

A text is a row of symbols: its bytes, or its words.  Suffixes of a whole corpus cannot be sorted in one place, so they are
dealt out by content.  Every window of ``least`` symbols is assigned to its anchor, the leftmost smallest hash of a few
symbols within it; equal windows have equal anchors at equal places.  Only anchors that occur twice can lie in a repeated
window.  An anchor's context is all symbols that windows assigned to it can cover.  Contexts that occur twice are repeated
whole.  The others of one anchor meet in a task: there the suffixes whose first ``least`` symbols repeat, at places where the
repeat cannot be extended to the left, are sorted into an enhanced suffix array, whose common-prefix intervals are scanned
with a stack; intervals whose occurrences follow different symbols are the maximal repeats, each with all its occurrences.

An anchor of very many contexts is worked on in chunks, each with the same one context beside it, the anchor's pivot.  A
window that equals the pivot's is found repeated in its chunk.  Any other window that two contexts share goes beyond the
place where they leave the pivot, so both leave it at the same place with the same symbol: contexts are dealt on by where and
how they leave it, to the right and to the left, into smaller groups that are worked on alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, modest_batches, saved, small
from tidemark.llm.shingles import give_back, mix, word_hashes

#: Contexts that one task sorts together: whole anchors, or chunks of one.
MOST_CONTEXTS = 4096
#: Bytes of contexts worked on together, bytes of texts, and symbols of a pass.
_GROUP_BYTES, _TEXT_BYTES, _PASS_BYTES = 1 << 19, 1 << 19, 2 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Alphabet:
    """What a text's symbols are: their numpy type, how many make an anchor, and the bytes that one takes at least."""

    kind: str
    gram: int
    least_bytes: int

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize

    def split(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, symbols of some texts end to end, bounds); very long texts come alone."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _TEXT_BYTES, "right")) - 1)
            if self.width == 1:
                yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            else:
                yield at, *word_hashes(texts.slice(at, to - at))
            at = to


#: Texts as bytes, and as words (runs of characters other than ASCII white space, told apart by 64-bit hashes).
AS_BYTES, AS_WORDS = Alphabet("u1", 32, 1), Alphabet("u8", 8, 2)


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all stretches of ``size`` symbols, by doubling."""
    power, have = _BYTES[data] if data.dtype == np.uint8 else mix(data), 1
    done, length, base = None, 0, _BASE
    while True:
        if size & have:
            if done is None:
                done, length = power, have
            else:  # what is done goes before the next power
                n = len(power) - length
                factor = np.uint64(pow(_BASE, have, 1 << 64))
                done = done[:n] * factor + power[length : length + n] if n > 0 else power[:0]
                length += have
        have *= 2
        if have > size:
            return mix(done)
        n = len(power) - have // 2
        if n <= 0:
            return np.empty(0, np.uint64)
        power = power[:n] * np.uint64(base) + power[have // 2 :]
        base = base * base % (1 << 64)


def anchors(data: np.ndarray, bounds: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, first window, last window, hash) of every anchor of texts laid end to end at ``bounds``.

    Places and windows count from the beginning of all the texts, of which there are less than 2**24 symbols.
    """
    grams = window_hashes(data, gram)
    width = least - gram + 1
    if len(grams) < width:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    place = (low & _PLACE).astype(np.int64)
    starts, ends = bounds[:-1], bounds[1:] - least  # first and last window of each text
    long = np.flatnonzero(ends >= starts)
    inside = np.zeros(len(place) + 1, np.int32)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = np.empty(len(place), bool)
    new[0] = True
    new[1:] = place[1:] != place[:-1]
    new[starts[long]] = True
    new &= valid
    first = np.flatnonzero(new)
    text = np.searchsorted(bounds, first, "right") - 1
    last = np.minimum(np.append(first[1:] - 1, len(place) - 1), ends[text])
    return text, place[first], first, last, grams[place[first]]


def all_anchors(data: np.ndarray, bounds: np.ndarray, least: int, gram: int = AS_BYTES.gram) -> tuple[np.ndarray, ...]:
    """The same for texts of any length: one that is too long for a pass is read in parts of so many windows."""
    if len(data) <= _PASS_BYTES:
        return anchors(data, bounds, least, gram)
    step, found = _PASS_BYTES - least + 1, []
    for text_begin, text_end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for at in range(text_begin, text_end - least + 1, step):
            part = data[at : min(at + _PASS_BYTES, text_end)]
            text, place, first, last, grams = anchors(part, np.array([0, len(part)]), least, gram)
            found.append((np.searchsorted(bounds, first + at, "right") - 1, place + at, first + at, last + at, grams))
    if not found:
        return anchors(data[:0], np.array([0, 0]), least, gram)
    text, place, first, last, grams = (np.concatenate(c) for c in zip(*found, strict=True))
    # An anchor whose windows lie in two parts was found in both.
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    return text[new], place[new], first[new], last[np.append(new[1:], len(last)) - 1], grams[new]


def maximal_repeats(suffixes: list[bytes], before: list[int], least: int, width: int = 1) -> Iterator[tuple[int, list[int]]]:
    """(length, numbers of the suffixes) of every maximal repeat of at least ``least`` symbols of ``width`` bytes.

    ``before`` has the symbol ahead of each suffix, or a number of its own where there is none.  The suffixes are sorted, the
    lengths of the common prefixes of neighbours taken, and the intervals of the common-prefix tree closed bottom-up from a
    stack.  An interval whose suffixes all follow the same symbol is part of a longer repeat and is passed over.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    prefix = [0, *(common_prefix(suffixes[a], suffixes[b]) // width for a, b in zip(order, order[1:], strict=False)), 0]
    stack: list[tuple[int, int]] = []  # (length, left end), lengths rising
    for i in range(1, len(order) + 1):
        left = i - 1
        while stack and stack[-1][0] > prefix[i]:
            length, left = stack.pop()
            inside = order[left:i]
            if len({before[x] for x in inside}) > 1:
                yield length, inside
        if prefix[i] >= least and (not stack or stack[-1][0] < prefix[i]):
            stack.append((prefix[i], left))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


@dataclass
class Context:
    """Symbols (as bytes) of text ``t`` from ``begin`` on, around an anchor at ``place``; its windows begin at first to last."""

    t: bytes
    place: int
    begin: int
    first: int
    last: int
    raw: bytes


def _repeated(contexts: list[Context], least: int, kind: str) -> Iterator[tuple[bytes, int, int]]:
    """(text, start, length) of every occurrence of every maximal repeat within contexts."""
    data = np.frombuffer(b"".join(c.raw for c in contexts), kind)
    if len(data) < least:
        return
    width = data.itemsize
    hashes = window_hashes(data, least)
    sizes = np.array([len(c.raw) // width for c in contexts])
    offsets = np.cumsum(sizes) - sizes
    counts = np.array([c.last - c.first + 1 for c in contexts])
    begin = offsets + np.array([c.first - c.begin for c in contexts])
    which = np.repeat(np.arange(len(contexts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    h = hashes[at]
    # Numbers of their own stand for what lies ahead of a context's first window.
    ahead = np.where(at > begin[which], (data[np.maximum(at - 1, 0)].astype(np.uint64) >> np.uint64(width > 1)).astype(np.int64), -1 - which)
    order = np.argsort(h, kind="stable")
    h, at, which, ahead = h[order], at[order], which[order], ahead[order]
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(edges, len(h)))
    diverse = (size > 1) & (np.minimum.reduceat(ahead, edges) != np.maximum.reduceat(ahead, edges)) if len(h) else np.zeros(0, bool)
    for e, n in zip(edges[diverse].tolist(), size[diverse].tolist(), strict=True):
        some = [(int(w), int(a)) for w, a in zip(which[e : e + n], at[e : e + n], strict=True)]
        tails = [contexts[w].raw[width * (a - int(offsets[w])) :] for w, a in some]
        for length, inside in maximal_repeats(tails, ahead[e : e + n].tolist(), least, width):
            for x in inside:
                w, a = some[x]
                yield contexts[w].t, contexts[w].begin + a - int(offsets[w]), length


def _lined_up(contexts: list[Context], kind: str, reach: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols from the anchor on, symbols ahead of the anchor from the nearest back), one row a context, -1 beyond its ends.

    Symbols are numbers that are equal for equal symbols of these contexts.
    """
    flat = np.frombuffer(b"".join(c.raw for c in contexts), kind)
    codes = flat.astype(np.int64) if kind == "u1" else np.unique(flat, return_inverse=True)[1].astype(np.int64)
    right, left = np.full((len(contexts), least), -1, np.int64), np.full((len(contexts), reach + 1), -1, np.int64)
    at = 0
    for i, c in enumerate(contexts):
        n, ahead = len(c.raw) // flat.itemsize, c.place - c.begin
        right[i, : n - ahead] = codes[at + ahead : at + n]
        left[i, :ahead] = codes[at : at + ahead][::-1]
        at += n
    return right, left


def _leaving(pivot: Context, contexts: list[Context], group: int, least: int, kind: str, reach: int) -> Iterator[tuple[int, Context]]:
    """(smaller group, context with the windows that go on there) of contexts, by where and how they leave the pivot.

    With l symbols ahead of the anchor and the others behind, a window goes to the right group if it holds the first symbol
    behind the anchor in which the context differs from the pivot, else to the left one if it holds the first ahead of it.
    """
    width = np.dtype(kind).itemsize
    right, left = _lined_up([pivot, *contexts], kind, reach, least)
    off_right, off_left = (np.concatenate([x[1:] != x[0], np.ones((len(contexts), 1), bool)], axis=1).argmax(axis=1) for x in (right, left))
    for c, r, l in zip(contexts, off_right.tolist(), off_left.tolist(), strict=True):
        low, high = c.place - c.last, c.place - c.first  # windows as symbols ahead of the anchor
        ahead = c.place - c.begin
        for side, a, b, k in (("r", low, min(high, least - r - 1), ahead + r), ("l", max(low, l + 1, least - r), high, ahead - l - 1)):
            if a <= b:
                symbol = c.raw[k * width : (k + 1) * width]
                deal = xxhash.xxh3_64_intdigest(symbol + f"{side}{r if side == 'r' else l},{group}".encode())
                yield deal - (1 << 63), Context(c.t, c.place, c.begin, c.place - b, c.place - a, c.raw)


_MEMBER = "g long, t binary, place long, begin long, first long, last long, raw binary"


def repeat_spans(docs: DataFrame, *, least: int = 400, alphabet: Alphabet = AS_BYTES) -> DataFrame:
    """``_t`` (a text's key, as text_key gives it) and spans (array of begin and end, in symbols): what a string of ``least``
    symbols covers that also starts elsewhere, in the same text or another.  Spans are maximal and in order.  Null texts and
    texts without such a string have no row; rows that repeat a text are occurrences like any other and share a row; an empty
    table gives an empty one.  The result rests on a table in the shared folder."""
    modest_batches(docs.sparkSession)
    kind, gram = alphabet.kind, min(alphabet.gram, max(1, least // 2))
    width, reach = alphabet.width, least - gram  # bytes of a symbol; symbols of a context ahead of its anchor, at most
    long_enough = F.octet_length("text") >= (alphabet.least_bytes * least - (alphabet.least_bytes - 1))
    texts = docs.select(text_key(F.col("text")).alias("t"), "text").where(long_enough)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            keep = []
            for t in batch.column(0).to_pylist():  # of equal texts in one task two are enough to tell that all is repeated
                seen[t] = seen.get(t, 0) + 1
                keep.append(seen[t] <= 2)
            if len(seen) > 250_000:
                seen.clear()
            batch = batch.filter(pa.array(keep, pa.bool_()))
            if not batch.num_rows:
                continue
            for number, data, bounds in alphabet.split(batch.column(1)):
                text, place, first, last, grams = all_anchors(data, bounds, least, gram)
                if not len(text):
                    continue
                begin, end = np.maximum(place - reach, bounds[text]), np.minimum(place + least, bounds[text + 1])
                raw, digest = data.tobytes(), xxhash.xxh3_128_digest
                found = b"".join([digest(raw[a:b]) for a, b in zip((begin * width).tolist(), (end * width).tolist(), strict=True)])
                halves = np.frombuffer(found, np.uint64).reshape(-1, 2)
                c1 = mix(halves[:, 0] + (place - begin).astype(np.uint64) * np.uint64(1 << 20) + (end - place).astype(np.uint64))
                numbers = [grams.view(np.int64), c1.view(np.int64), np.ascontiguousarray(halves[:, 1]).view(np.int64)]
                places = [pa.array(x - bounds[text], pa.int64()) for x in (place, first, last)]
                yield pa.record_batch([*[pa.array(x) for x in numbers], batch.column(0).take(pa.array(number + text)), *places], ["h", "c1", "c2", "t", "place", "first", "last"])
        give_back()

    found = saved(texts.mapInArrow(find, "h long, c1 long, c2 long, t binary, place long, first long, last long"), "anchors")
    classes = found.groupBy("h", "c1", "c2").agg(F.count("*").alias("k"), F.min(F.struct("t", "place", "first", "last")).alias("one"))
    every = saved(classes, "classes")
    # Anchors that occur twice; written, so that the join with one that has very many contexts can be split over tasks.
    per_anchor = saved(every.groupBy("h").agg(F.sum("k").alias("total"), F.count("*").alias("kinds")).where("total >= 2"), "busy")
    classes = saved(every.join(small(per_anchor), "h"), "repeated")
    spent = [found, every, per_anchor, classes]
    whole = found.join(classes.where("k >= 2").select("h", "c1", "c2"), ["h", "c1", "c2"]).select("t", F.col("first").alias("a"), (F.col("last") + least).alias("b"))
    wanted = classes.where("kinds >= 2").select("h", "kinds", "one.*")
    per_text = wanted.groupBy("t").agg(F.collect_list(F.struct("h", "kinds", "place", "first", "last")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        names = ["n", "g", "t", "place", "begin", "first", "last", "raw"]
        types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.binary()]
        for batch in batches:
            for i, (t, spots) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2)), strict=True)):
                if t in seen:
                    continue
                if len(seen) > 250_000:
                    seen.clear()
                seen.add(t)
                raw = next(alphabet.split(batch.column(1).slice(i, 1)))[1].tobytes()
                for low in range(0, len(spots), 8192):
                    rows = []
                    for s in spots[low : low + 8192]:
                        begin = max(0, s["place"] - reach)
                        rows.append((s["kinds"], s["h"], t, s["place"], begin, s["first"], s["last"], raw[begin * width : (s["place"] + least) * width]))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)
        give_back()

    cut = texts.join(per_text, "t").select("t", "text", "wanted").mapInArrow(fetch, "n long, " + _MEMBER)
    level = saved(cut, "contexts")  # rows that repeat a text in other tasks repeat its contexts
    return _all_spans(level, whole, least, kind, reach, spent)


_MEMBERS = ["t", "place", "begin", "first", "last", "raw"]


def _all_spans(level: DataFrame, whole: DataFrame, least: int, kind: str, reach: int, spent: list[DataFrame]) -> DataFrame:
    """The spans of repeat_spans, from the contexts of all anchors (``level``) and spans that are known already.

    Groups of up to MOST_CONTEXTS contexts meet in a task.  Of larger ones every chunk meets its group's pivot, and the contexts
    go on in smaller groups, none with the pivot; as a pivot is drawn by hash, groups shrink as fast as those of a sort do.
    """

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            for g, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now and size >= _GROUP_BYTES:
                    yield from _span_batches(_repeated(held, least, kind))
                    held, size = [], 0
                if held and g == now and (rest[0], rest[3], rest[4]) == (held[-1].t, held[-1].first, held[-1].last):
                    continue
                now = g
                held.append(Context(*rest))
                size += len(rest[-1])
        yield from _span_batches(_repeated(held, least, kind) if held else ())
        give_back()

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans (as first and last), and contexts that go on; the pivot is the first row of its chunk."""
        pivot, held, now = None, [], None
        names, types = ["g", *_MEMBERS], [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.binary()]

        def done() -> Iterator[pa.RecordBatch]:
            for found in _span_batches(_repeated([pivot, *held], least, kind)):
                n = found.num_rows
                none, zero = pa.nulls(n, pa.binary()), pa.array(np.zeros(n, np.int64))
                yield pa.record_batch([pa.nulls(n, pa.int64()), found.column(0), zero, zero, found.column(1), found.column(2), none], names)
            rows = [(g, c.t, c.place, c.begin, c.first, c.last, c.raw) for g, c in _leaving(pivot, held, now[0], least, kind, reach)]
            for low in range(0, len(rows), 4096):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[low : low + 4096], strict=True), types, strict=True)], names)

        for batch in batches:
            for g, chunk, is_pivot, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Context(*rest)
                if is_pivot:
                    if held:
                        yield from done()
                    pivot, held, now = own, [], (g, chunk)
                elif not any((own.t, own.first, own.last) == (c.t, c.first, c.last) for c in (pivot, *held[-1:])):
                    held.append(own)
        if held:
            yield from done()
        give_back()

    spans = [whole]
    while True:
        spent.append(level)
        few = level.where(F.col("n") <= MOST_CONTEXTS).select("g", *_MEMBERS).repartition("g").sortWithinPartitions("g", "t", "first")
        spans.append(few.mapInArrow(by_group, "t binary, a long, b long"))
        many = level.where(F.col("n") > MOST_CONTEXTS)
        if many.isEmpty():
            break
        chunks = F.ceil(F.col("n") / MOST_CONTEXTS).cast("int")
        pivots = many.groupBy("g", "n").agg(F.max_by(F.struct(*_MEMBERS), F.xxhash64("t", "first")).alias("p"))
        pivots = pivots.select("g", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(True).alias("pivot"), "p.*")
        others = many.select("g", F.pmod(F.xxhash64("first", "t"), chunks).cast("int").alias("chunk"), F.lit(False).alias("pivot"), *_MEMBERS)
        dealt = pivots.union(others).repartition("g", "chunk").sortWithinPartitions("g", "chunk", F.desc("pivot"), "t", "first")
        out = saved(dealt.mapInArrow(by_chunk, _MEMBER), "round")
        spans.append(out.where("g is null").select("t", F.col("first").alias("a"), F.col("last").alias("b")))
        on = out.where("g is not null")
        sizes = on.groupBy("g").agg(F.count("*").alias("n")).where("n >= 2")
        level = saved(on.join(sizes, "g").select("n", "g", *_MEMBERS), "contexts")
        spent.append(out)
    every = spans[0]
    for more in spans[1:]:
        every = every.union(more)
    together = every.groupBy("t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    merged = saved(together.mapInArrow(_merge, "_t binary, spans array<struct<a: long, b: long>>"), "spans")
    for table in spent:
        discard(table)
    return merged


def _span_batches(found: Iterator[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
    rows = list(dict.fromkeys((t, a, a + n) for t, a, n in found))
    types = [pa.binary(), pa.int64(), pa.int64()]
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], ["t", "a", "b"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        flat = batch.column(1).flatten()
        lengths = pc.list_value_length(batch.column(1)).to_numpy()
        a, b = (pc.struct_field(flat, i).to_numpy() for i in (0, 1))
        out, at = [], 0
        for n in lengths.tolist():
            out.append([{"a": p, "b": q} for p, q in merged_spans(a[at : at + n], b[at : at + n])])
            at += n
        yield pa.record_batch([batch.column(0), pa.array(out, kind)], ["_t", "spans"])


def merged_spans(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spans from a to b, in order, with those that overlap or touch put together."""
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return list(zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist(), strict=True))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text))


def _words_as_bytes(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, from the first word's begin to the last one's end."""
    if not spans:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]])))
    begins, ends = edges[::2], edges[1::2]
    return [(int(begins[a]), int(ends[b - 1])) for a, b in spans]


def remove_repeats(
    docs: DataFrame, *, least: int = 400, least_words: int | None = None, report_words: int | None = None, whole_characters: bool = False
) -> DataFrame:
    """Every row with ``spans`` (array of begin and end, in bytes, maximal and in order; empty without any) and ``kept``
    (binary), the bytes of ``text`` outside of them.

    A byte goes when a string of ``least`` bytes covers it that also starts anywhere else, in the same text or another, in
    the input as it is; with ``least_words``, also when a string of so many words does that also occurs elsewhere, whatever
    white space is between them, from the first word's begin to the last one's end.  All such places go, none is spared.
    With ``report_words`` a column ``passages`` (array of begin and end, in words) tells what strings of so many words cover
    that also occur elsewhere; these stay.  With ``whole_characters`` a span gives up bytes of characters that it covers in
    part, so that ``kept`` is valid UTF-8.

    Matches never cross texts.  A null or short text has no spans and is kept as it is (null: empty).  Repeated rows are
    occurrences like any other.  An empty table gives an empty result.  Input columns named like the added ones are replaced.
    """
    modest_batches(docs.sparkSession)
    added = ["spans", "kept"] + (["passages"] if report_words else [])
    docs = docs.drop(*added)
    marked = docs.withColumn("_t", text_key(F.col("text"))).join(small(repeat_spans(docs, least=least), "spans"), "_t", "left")
    none = F.array().cast("array<struct<a: long, b: long>>")
    for n, column in ((least_words, "_words"), (report_words, "passages")):
        found = small(repeat_spans(docs, least=n, alphabet=AS_WORDS), "spans").withColumnRenamed("spans", column) if n else None
        marked = marked.join(found, "_t", "left") if n else marked.withColumn(column, none)
    marked = marked.drop("_t").withColumns({c: F.coalesce(c, none) for c in ("spans", "_words", "passages")})

    @F.pandas_udf("a array<long>, b array<long>, kept binary")
    def cut(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            rows: list[tuple] = []
            for text, *ends in zip(*columns, strict=True):
                if text is None:
                    rows.append(([], [], b""))
                    continue
                raw = text.encode()
                a, b, c, d = ([int(x) for x in own] for own in ends)
                own = list(zip(a, b, strict=True))
                if c:
                    own += _words_as_bytes(raw, list(zip(c, d, strict=True)))
                    own = merged_spans(*(np.array(side, np.int64) for side in zip(*own, strict=True)))
                own = [_whole(raw, x, y) for x, y in own] if whole_characters else own
                own = [(x, y) for x, y in own if x < y]
                edges = [0, *(e for span in own for e in span), len(raw)]
                left = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append(([x for x, _ in own], [y for _, y in own], left))
            yield pd.DataFrame(rows, columns=["a", "b", "kept"])

    # Only texts that lose something are handed over.
    found = (F.size("spans") > 0) | (F.size("_words") > 0)
    marked = marked.withColumn("_k", cut(F.when(found, F.col("text")), *[F.col(f"{c}.{side}") for c in ("spans", "_words") for side in "ab"]))
    whole = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    pairs = F.coalesce(F.zip_with("_k.a", "_k.b", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), none)
    marked = marked.withColumns({"spans": pairs, "kept": F.when(found, F.col("_k.kept")).otherwise(whole)})
    return marked.select(*docs.columns, *added)


def _whole(raw: bytes, a: int, b: int) -> tuple[int, int]:
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b
