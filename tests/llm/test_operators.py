"""Every operator on awkward rows, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import ann, common, fingerprints, mixing, ngram_join, packing, sharding, suffix_dedup, token_io, tokens, toxicity, url_filter
from tidemark.llm.common import connected_components, new_folder
from tests.llm.conftest import frame, words

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


# ---------------------------------------------------------------- url filter
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net", "block"), ("a.net/x/y", "allow"), ("a.net/x/y", "block")]


def brute_url(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
        host, rest = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:]
        path = rest[: min([i for i, c in enumerate(rest) if c in "?#"] or [len(rest)])]
    best = None
    for rule, verdict in RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            rank = (len(rule), len(h), verdict == "block")
            best = max(best, (rank, rule, verdict)) if best else (rank, rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "http://Example.COM/en/77?x=/en/", "https://example.com/en/8", "x://sub.example.com/en/7", "http://notcom/en/", "http://b.a.net/x/y/z",
            "http://a.net/x/yz", "http://com", "http://com/en", "http://com/en/", "http://.com/en/", "ftp://u:p@b.net:80#f", "a://b://c.com/en/", "http://ÄB.com/en/é", "http://x.com/en/\nq"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(4, urls[4], "clash")], "page_id long, url string, verdict string")
    found = url_filter.filter_urls(df, RULES).select("url", "host", "path", "rule", "verdict").collect()
    assert len(found) == len(urls) + 1
    for r in found:
        assert tuple(r)[1:] == brute_url(r.url), r
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.RuleTrie([("a", "maybe")])


# ---------------------------------------------------------------- toxicity
def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = words(rng, 80, 300)
        if toxic:
            parts = text.split()
            for k in range(4):
                parts.insert(rng.randrange(len(parts)), ("grob" + rng.choice(["an", "el", "ung"]), "dumpfer")[k % 2])
            text = " ".join(parts)
        else:
            text += " grobschmied" if i % 3 == 0 else ""
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled(random.Random(1), 400)
    rows += [(900, None), (901, ""), (902, "GR0BUNG dumрfer gr0ban ordinary text with dumpfer"), (903, "a grobschmied and another grobschmied"), (None, "x"), (0, rows[0][1])]
    docs = frame(spark, rows).withColumn("score", F.lit("clash"))
    known = spark.createDataFrame(labels + [(None, 1), (5, None), (7, 3)], "doc_id long, toxic int")
    lexicon = toxicity.fit_lexicon(docs, known.where("doc_id % 3 <> 1 or doc_id is null"))
    assert any(t.startswith("dump") for t in lexicon.terms) and any(t.startswith("grob") for t in lexicon.terms)
    got = defaultdict(list)
    for r in toxicity.score_toxicity(docs, lexicon).select("doc_id", "score").collect():
        got[r.doc_id].append(r.score)
    assert sum(map(len, got.values())) == len(rows)
    held = [i for i, _ in labels if i % 3 == 1]
    assert all((got[i][0] >= 0.7) == bool(labels[i][1]) for i in held)
    assert got[902][0] >= 0.7 and got[903][0] < 0.7 and got[900] == got[901]
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0
    empty = toxicity.fit_lexicon(docs, known.limit(0))
    assert empty.terms == {} and 0 <= empty.score("anything") < 0.7


def test_exceptions_cover_matches():
    lexicon = toxicity.Lexicon({"clown": 3.0}, {"clown fish"})
    assert lexicon.weight("a clown fish and a clown")[0] == 3.0
    assert lexicon.weight("a clown fisher")[0] == 3.0
    assert lexicon.weight("aclown")[0] == 0.0


def test_matches_are_those_of_a_plain_search():
    rng = random.Random(31)
    for _ in range(300):
        word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))
        lexicon = toxicity.Lexicon({word(): float(rng.randrange(1, 9)) for _ in range(4)}, {" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(3)})
        own = [word() for _ in range(rng.randrange(12))]
        safe = set()
        for phrase in lexicon.exceptions:
            p = phrase.split()
            safe |= {i + k for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p for k in range(len(p))}
        expected = sum(w for i, x in enumerate(own) if i not in safe for t, w in lexicon.terms.items() if x.startswith(t))
        text = "".join(x.upper() + rng.choice([" ", "\t", ", ", "_\n"]) for x in own)
        assert lexicon.weight(text) == (expected, len(own))
        assert lexicon.weight(text.replace("A", "\u0410").replace("B", "8")) == (expected, len(own))


def test_exception_phrases_are_learned(spark):
    rng = random.Random(32)
    rows, labels = [], []
    for i in range(300):
        parts = words(rng, 60).split()
        for _ in range(3):
            parts.insert(rng.randrange(len(parts)), "dirty" if i % 2 else "pleasant")
        if i % 8 == 0:
            parts.insert(rng.randrange(len(parts)), "dirty laundry")
        rows.append((i, " ".join(parts)))
        labels.append((i, i % 2))
    rows += [(5, "x" * 50)] * 3
    lexicon = toxicity.fit_lexicon(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("dirty".startswith(t) for t in lexicon.terms) and "dirty laundry" in lexicon.exceptions
    assert lexicon.weight("the dirty laundry")[0] == 0 < lexicon.weight("the dirty dog")[0]


def test_a_lexicon_is_fitted_without_rows_from_the_driver(spark, monkeypatch):
    """Rows that the driver hands over are read by Python workers of their own, which stay beside those of the functions."""
    rng = random.Random(25)
    rows = [(i, words(rng, 30, 300) + (" vileword" * 3 if i % 2 else "")) for i in range(80)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    given = []
    plain = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: given.append(a) or plain(self, *a, **b))
    lexicon = toxicity.fit_lexicon(docs, labels)
    assert not given
    assert lexicon.score("w1 w2 vileword w3") > lexicon.score("w1 w2 w3")


# ---------------------------------------------------------------- fingerprints
def bag(text):
    w = split(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 1.0


@pytest.mark.parametrize(("bucket_docs", "coarse"), [(10, 1024), (1000, 1024), (4, 3)])
def test_edited_fingerprints(spark, corpus, bucket_docs, coarse, monkeypatch):
    monkeypatch.setattr(fingerprints, "COARSE", coarse)
    docs = frame(spark, corpus).withColumn("own", F.lit(1))
    found = fingerprints.edited_fingerprints(docs, bucket_docs=bucket_docs)
    near = fingerprints.likeness
    found = found.select("doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("own")).alias("f"), near(F.col("own"), F.col("other")).alias("e"), near(F.col("own"), F.col("next")).alias("n"))
    rows = {r.doc_id: r for r in found.collect()}
    ordered = sorted(((i, t or "") for i, t, *_ in corpus if i is not None), key=lambda r: -r[0]) + [(i, t) for i, t, *_ in corpus if i is None]
    assert found.count() == len(corpus)
    errors = []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        if i == 205:  # two rows, each other's neighbour on one side
            continue
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.e - jaccard(bag(text), bag(edited)), r.n - jaccard(bag(text), bag(after))]
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.3
    by_text = defaultdict(set)
    for i, text in ordered:
        by_text[text].add(rows[i].f)
    assert all(len(f) == 1 for f in by_text.values())
    assert rows[201].f == "" and fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
    assert fingerprints.edited_fingerprints(docs.where("doc_id = 5")).count() == 1


def test_stretches_follow_the_order(spark, monkeypatch):
    """Also where one doc_id, or none, has a third of the rows."""
    monkeypatch.setattr(fingerprints, "COARSE", 7)
    rng = random.Random(51)
    rows = [(rng.choice([None, 5, rng.randrange(10**12)]), f"text {i}") for i in range(6000)]
    base = frame(spark, rows).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_k"), F.xxhash64("text").alias("_h"))
    got = sorted(((r["_k"], r["_h"]), r["_b"]) for r in fingerprints._in_stretches(base, 20).collect())
    numbers = [b for _, b in got]
    sizes = Counter(numbers)
    assert len(got) == 6000 and numbers == sorted(numbers) and 200 < len(sizes) < 400 and max(sizes.values()) < 120


def test_weighted_samples_estimate_generalised_jaccard(spark):
    texts = [(1, " ".join(["a b c d e"] * 6)), (2, " ".join(["a b c d e"] * 3)), (3, " ".join(["a b c d e"] * 3 + ["v w x y z"] * 3)), (4, None)]
    rows = {r.doc_id: r.samples for r in fingerprints.fingerprint(frame(spark, texts), "doc_id", samples=256).collect()}
    for a, b in ((1, 2), (1, 3), (2, 3)):
        same = np.mean([x == y for x, y in zip(rows[a], rows[b], strict=True)])
        assert abs(same - jaccard(bag(texts[a - 1][1]), bag(texts[b - 1][1]))) < 0.11
    assert all(x is None for x in rows[4])


# ---------------------------------------------------------------- sharding
@pytest.mark.parametrize("range_bytes", [400, 64 << 20])
def test_shards(spark, corpus, range_bytes):
    rows = [r for r in corpus if r[0] != 206] + [(1000 + i, corpus[7][1]) for i in range(100)]
    docs = frame(spark, rows).withColumn("shard", F.lit("clash"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    out = sharding.shard_by_size(docs, 6, size=size, group=F.xxhash64("text"), tie=F.col("doc_id"), range_bytes=range_bytes)
    got = out.select("doc_id", "text", "shard", "slot").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((r[0], r[1]) for r in rows), key=key)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(len((r[1] or "").encode()) + 8 for r in rows)
    assert len(sizes) == 6 and max(sizes.values()) - min(sizes.values()) <= 2 * biggest
    assert sharding.shard_by_size(docs.limit(0), 6, size=size, group=F.xxhash64("text"), tie=F.col("doc_id")).count() == 0


# ---------------------------------------------------------------- suffix arrays
def brute_removed(texts, least):
    seen = Counter()
    for t in texts:
        for i in range(len(t) - least + 1):
            seen[t[i : i + least]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        out.append(gone[:-1])
    return out


@pytest.mark.parametrize("contexts", [4096, 2])
def test_repeats(spark, corpus, contexts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", contexts)
    monkeypatch.setattr(suffix_dedup, "_PASS_BYTES", 20_000)
    rows = [r for r in corpus if r[0] is None or r[0] < 140 or r[0] > 155]
    docs = frame(spark, rows).withColumn("kept", F.lit("clash"))
    got = suffix_dedup.remove_repeats(docs, least=64).select("doc_id", "text", "spans", "kept").collect()
    texts = [(r.text or "").encode() for r in got]
    assert len(got) == len(rows)
    for r, t, gone in zip(got, texts, brute_removed(texts, 64), strict=True):
        assert bytes(r.kept) == bytes(np.frombuffer(t, np.uint8)[~gone]), r.doc_id
        assert [(s.a, s.b) for s in r.spans] == [tuple(x) for x in np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)]
    assert suffix_dedup.remove_repeats(docs.limit(0), least=64).count() == 0
    whole = suffix_dedup.remove_repeats(frame(spark, [(1, "é" * 90), (2, "x" + "é" * 90)]), least=65, whole_characters=True).collect()
    assert [r.kept.decode() for r in whole] in (["", "x"], ["x", ""])


def brute_passages(texts, n):
    """Runs of words, as begin and end, that strings of n words cover which occur twice."""
    lists = [split(t) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    out = []
    for w in lists:
        gone = np.zeros(len(w) + 2, bool)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i + 1 : i + n + 1] = True
        out.append([tuple(x) for x in np.flatnonzero(np.diff(gone)).reshape(-1, 2).tolist()])
    return out


@pytest.mark.parametrize("contexts", [4096, 3])
def test_repeats_of_words(spark, corpus, contexts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", contexts)
    rows = [r for r in corpus if r[0] is None or r[0] < 140 or r[0] > 155]
    got = suffix_dedup.remove_repeats(frame(spark, rows), least=100_000, report_words=12).select("text", "passages").collect()
    for r, passages in zip(got, brute_passages([r.text for r in got], 12), strict=True):
        assert [tuple(p) for p in r.passages] == passages
    both = suffix_dedup.remove_repeats(frame(spark, [(1, "q " + "é" * 9 + " b\nc d"), (2, "é" * 9 + " b c  d e")]), least=100, least_words=4).collect()
    assert sorted(bytes(r.kept) for r in both) == [b" e", b"q "]


@pytest.mark.parametrize("seed", range(4))
def test_one_anchor_of_thousands_of_contexts(spark, seed, monkeypatch):
    """All texts share a core that every window holds, and differ before and behind it, some of them alike."""
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", (7, 40, 150, 5000)[seed])
    rng = random.Random(seed)
    core = "".join(rng.choice("abcdefghijklmnop") for _ in range(48))
    some = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    texts = [some(rng.randrange(18)) + core + some(rng.randrange(18)) for _ in range(3000)]
    got = suffix_dedup.remove_repeats(frame(spark, list(enumerate(texts))), least=60).select("text", "spans").collect()
    raw = [r.text.encode() for r in got]
    for r, gone in zip(got, brute_removed(raw, 60), strict=True):
        assert [(s.a, s.b) for s in r.spans] == [tuple(x) for x in np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)]


def test_anchors_of_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    bounds = np.array([0, 9000, 9010, 9010, 15000])
    for data in (rng.integers(0, 4, 15000).astype(np.uint8), rng.integers(0, 4, 15000).astype(np.uint64)):
        whole = suffix_dedup.anchors(data, bounds, 64, 8)
        monkeypatch.setattr(suffix_dedup, "_PASS_BYTES", 2000)
        parts = suffix_dedup.all_anchors(data, bounds, 64, 8)
        monkeypatch.undo()
        windows = lambda found: {(t, p, w, int(h)) for t, p, a, b, h in zip(*(x.tolist() for x in found), strict=True) for w in range(a, b + 1)}
        assert windows(whole) == windows(parts)


def test_maximal_repeats_have_all_their_occurrences():
    text = b"xabcdeYabcdeZabcdyxabcdeQ"
    suffixes = [text[i:] for i in range(len(text))]
    before = [text[i - 1] if i else -1 for i in range(len(text))]
    found = {(n, tuple(sorted(at))) for n, at in suffix_dedup.maximal_repeats(suffixes, before, 4)}
    assert found == {(6, (0, 18)), (5, (1, 7, 19)), (4, (1, 7, 13, 19))}


# ---------------------------------------------------------------- packing
def test_first_fit_decreasing():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 60) for _ in range(200)]
    got = packing.first_fit_decreasing(lengths, 64)
    rooms = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = next((k for k, used in enumerate(rooms) if used + lengths[i] <= 64), len(rooms))
        if k == len(rooms):
            rooms.append(0)
        assert got[i] == (k, rooms[k])
        rooms[k] += lengths[i]
    with pytest.raises(ValueError):
        packing.BinTree(4, 1).place(5)


def test_packing(spark, corpus):
    docs = frame(spark, corpus).withColumn("start", F.lit("clash"))
    rows = packing.pack_documents(docs, tokens.default_path(), sequence_length=256, group_docs=50).collect()
    whole = Tokenizer.from_file(tokens.default_path())
    expected = Counter((i, np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t, *_ in corpus)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, ids in expected:
        own = sorted(by_doc[doc_id], key=lambda r: r.start)
        if expected[(doc_id, ids)] == 1:
            assert b"".join(bytes(r.ids) for r in own) == ids and all(r.doc_tokens * 4 == len(ids) for r in own)
        else:
            assert len(own) == 2 and all(bytes(r.ids) == ids for r in own)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= 256
    assert packing.pack_documents(docs.limit(0), tokens.default_path()).count() == 0


# ---------------------------------------------------------------- mixing
def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, corpus):
    docs = frame(spark, corpus).withColumns({"size": F.lit("clash"), "target": F.lit("clash")})
    documents, pieces = mixing.mix_sources(docs, block_words=8)
    own = documents.select("row_id", "doc_id", "text", "source", "size", "source_size", "target").collect()
    assert len(own) == len(corpus) == len({r.row_id for r in own})
    sizes = Counter()
    for r in own:
        assert r.size == len(split(r.text))
        sizes[r.source] += r.size
    targets = brute_targets(sizes)
    taken = Counter()
    parts = pieces.collect()
    rows = {r.row_id: r for r in own}
    for p in parts:
        taken[p.row_id] += p.n_words
        assert 0 <= p.first_word and p.first_word + p.n_words <= rows[p.row_id].size
    by_source = Counter()
    for r in own:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        assert taken[r.row_id] <= 3 * r.size
        by_source[r.source] += taken[r.row_id]
    for s in sizes:
        assert abs(by_source[s] - targets[s]) <= 8 * 3, s
    assert sorted(map(tuple, mixing.mix_sources(docs, block_words=8)[1].collect())) == sorted(map(tuple, parts))
    texts = mixing.mixed_texts(documents.select("row_id", "text"), pieces).select("row_id", "first_word", "n_words", "text").collect()
    for t in texts:
        assert split(t.text) == split(rows[t.row_id].text)[t.first_word : t.first_word + t.n_words]
    none = mixing.mix_sources(docs.limit(0))
    assert none[0].count() == none[1].count() == 0


def test_shards_draw_their_counts(spark):
    """Counts by shard spread like a multinomial draw, totals are the targets' slots, and a small source keeps its share."""
    rng = random.Random(9)
    rows = [(i, words(rng, 400), f"s{i % 3}") for i in range(300)] + [(900, words(rng, 40), "s9")]
    documents, pieces = mixing.mix_sources(frame(spark, rows), block_words=8, shard_slots=100)
    source = {r.row_id: r.source for r in documents.collect()}
    target = {r.source: r.target for r in documents.collect()}
    by_shard, slots, taken = defaultdict(Counter), defaultdict(set), Counter()
    for p in pieces.collect():
        slots[p.shard].add(p.slot)
        by_shard[p.shard][source[p.row_id], p.slot] += 1
        taken[source[p.row_id]] += p.n_words
    last = max(slots)
    assert all(len(s) == 100 and min(s) == 100 * k and max(s) == 100 * k + 99 for k, s in slots.items() if k < last)
    assert all(abs(taken[s] - t) <= 8 for s, t in target.items()) and abs(taken["s9"] - target["s9"]) <= 2
    counts = [len({x for s, x in by_shard[k] if s == "s0"}) for k in range(last)]
    p = target["s0"] / sum(target.values())
    assert abs(np.mean(counts) - 100 * p) < 2 and 0.6 < np.var(counts) / (100 * p * (1 - p)) < 1.5


def test_words_are_counted_in_one_scan(spark, corpus):
    documents, pieces = mixing.mix_sources(frame(spark, corpus), columns=["doc_id"])
    assert documents.columns == ["doc_id", "row_id", "size", "source_size", "target"]
    assert all("regexp" not in df._jdf.queryExecution().toString() for df in (documents, pieces))


def test_index_permutation(spark):
    for n in (1, 2, 97, 1000, 15_485_863):
        df = spark.range(min(n, 5000)).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(123456789).cast("long")).alias("p"))
        got = [r.p for r in df.collect()]
        assert len(set(got)) == len(got) and 0 <= min(got) and max(got) < n


# ---------------------------------------------------------------- n-gram join
def brute_components(rows, k, percent):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    low = {}
    for x, (i, *_) in enumerate(rows):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    return [(i, len(s), low.get(find(x)) if s else i) for x, ((i, *_), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 512), (3, 60, 3)])
def test_near_duplicates(spark, corpus, k, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "MOST_BLOCKS", 1 if block < 512 else 32)
    rng = random.Random(k)
    rows = [r for r in corpus if r[0] != 206]
    base = words(rng, 60).split()
    for i in range(300, 340):  # a family whose members are alike in chains and in borderline cases
        own = list(base)
        for _ in range(rng.randrange(1, 7)):
            own[rng.randrange(len(own))] = f"y{rng.randrange(50)}"
        rows.append((i, " ".join(own)))
    docs = frame(spark, rows).withColumn("component_id", F.lit("clash"))
    got = ngram_join.near_duplicates(docs, words=k, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows, k, percent), key=key)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_a_document_without_an_id_links_its_neighbours(spark):
    rng = random.Random(21)
    chain = [words(rng, 120).split()]
    for _ in range(2):
        own = list(chain[-1])
        for at in rng.sample(range(120), 2):
            own[at] = f"z{rng.randrange(1000)}"
        chain.append(own)
    rows = [(1, " ".join(chain[0])), (None, " ".join(chain[1])), (3, " ".join(chain[2])), (None, "alone " * 9)]
    got = ngram_join.near_duplicates(frame(spark, rows), words=4, percent=85).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows, 4, 85), key=key)
    assert {r.component_id for r in got} == {1, None}


def test_a_busy_word_is_split_by_second_words(spark, monkeypatch):
    """Documents that share one rare passage meet under its words; the rows dealt out grow with the documents."""
    rng = random.Random(22)
    dealt = []
    compared = ngram_join._compared
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "MOST_BLOCKS", 2)
    monkeypatch.setattr(ngram_join, "_compared", lambda rest, *more: dealt.append(ngram_join._in_blocks(rest, "key").count()) or compared(rest, *more))
    for n in (200, 800):
        passage = words(rng, 14, 10**6)
        rows = []
        for i in range(n):
            own = words(rng, 40, 10**6).split()
            rows.append((3 * i, " ".join([*own, passage])))
            if i % 10 == 0:
                own[5] = "other"
                rows.append((3 * i + 1, " ".join([*own, passage])))
        got = ngram_join.near_duplicates(frame(spark, rows), words=4, percent=70).select("doc_id", "component_id").collect()
        assert {r.doc_id: r.component_id for r in got} == {i: i - i % 3 for i, _ in rows}
    assert dealt[1] <= 8 * dealt[0] + 1000


def test_common_shingles_are_counted_over_all_documents(spark):
    """Phrases in 3 of 8,000 rows or more are common; of 10,000 rows that is 4, wherever these lie."""
    rng = random.Random(23)
    phrases = [words(rng, 4, 10**9) for _ in range(60)]
    rows = [(i, words(rng, 4, 10**9)) for i in range(10_000)]
    spots = rng.sample(range(10_000), 30 * 4 + 30 * 3)
    for number, phrase in enumerate(phrases):
        for _ in range(4 if number < 30 else 3):
            rows[spots.pop()] = (0, phrase)
    rows = [(i, f"{text} own{i}") for i, (_, text) in enumerate(rows)]
    docs = frame(spark, rows).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("own"))
    table = np.unpackbits(ngram_join._common(docs, 4, True), bitorder="little")
    hashes = np.concatenate(list(ngram_join.shingle_sets(pa.array(phrases[:30]), 4)))
    assert set(np.flatnonzero(table).tolist()) == set((hashes >> np.uint64(64 - ngram_join.COMMON_BITS)).tolist())


def test_filed_words_are_shuffled_once(spark, monkeypatch):
    """However many words are shared: with nothing broadcast, one stage alone writes as many rows as there are filed words."""
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    rng = random.Random(24)
    rows = [(2 * i, words(rng, 120, 10**6)) for i in range(200)]
    rows += [(i + 1, text.replace(text.split()[5], "other")) for i, text in rows[:40]]
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    last = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ngram_join.near_duplicates(frame(spark, rows), words=4, percent=85).select("doc_id", "component_id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}
    none = np.zeros((1 << ngram_join.COMMON_BITS) // 8, np.uint8)
    filed = sum(len(k) for h in ngram_join.shingle_sets(pa.array([text for _, text in rows]), 4) for k in ngram_join.filed_words(h, 85, none))
    now = stages()
    written = [s.shuffleWriteRecords() for s in map(now.apply, range(now.size())) if s.stageId() > last]
    assert sum(n >= filed * 9 // 10 for n in written) == 1, (filed, sorted(written)[-8:])


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 40, 900):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 4 :], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)]))
        rows = ngram_join.folded([ngram_join.long_sketch(a), ngram_join.long_sketch(b)])
        assert int(np.bitwise_count(rows[0] ^ rows[1]).sum()) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (50, 50), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(31)} | {90: 90, 95: 90, 100: 90, 50: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_write_no_more_tables_and_files_than_they_need(spark, monkeypatch):
    rng, written, plain = random.Random(9), [], common.saved

    def counted(df, *args):
        out = plain(df, *args)
        written.append(len(out.inputFiles()))
        return out

    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(common, "saved", counted)
        stars = [(10 * (i % 5), 10 * (i % 5) + 1 + i // 5) for i in range(40)]
        assert dict(map(tuple, connected_components(spark.createDataFrame(stars, "a long, b long")).collect())) == {x: x // 10 * 10 for e in stars for x in e}
        assert len(written) == 2 and written[1] <= 8  # the links, and the smallest neighbours, which show that the stars are settled
        edges, label = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, 7), (900, 900)], {}
        for a, b in edges:
            a, b = label.setdefault(a, a), label.setdefault(b, b)
            label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
        assert dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect())) == label
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ---------------------------------------------------------------- token files
def test_token_files(spark, corpus):
    docs = frame(spark, corpus).withColumn("start", F.lit("clash"))
    manifest = token_io.write_sequences(docs, tokens.default_path(), new_folder(spark, "tokens"), end_id=2, length=32)
    rows = token_io.read_documents(spark, manifest).orderBy("start").collect()
    whole = Tokenizer.from_file(tokens.default_path())
    ordered = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, t, *_) in zip(rows, ordered, strict=True):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    file = token_io.SequenceFile(manifest[0][0])
    assert len(file) == -(-manifest[0][3] // 32) and not file.sequence(0).flags.owndata
    masks = np.concatenate([np.array(file.mask(i)) for i in range(len(file))])
    assert masks.sum() == manifest[0][3]
    empty = token_io.write_sequences(docs.limit(0), tokens.default_path(), new_folder(spark, "tokens"), end_id=2)
    assert empty == [] and token_io.read_documents(spark, empty).count() == 0


# ---------------------------------------------------------------- neighbours
def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:300] = x[100]  # a hot vector
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(600, None, ""), (620, [0.0] * 16, ""), (640, [float("nan")] + [1.0] * 15, ""), (660, [None] + [1.0] * 15, ""), (680, [1.0] * 3, ""), (None, [1.0] * 16, ""), (20, x[20].tolist(), "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        scores = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:10]
        assert [k for k, *_ in found] == list(range(1, 11))
        assert all(abs(scores[v] - s) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(order))
    assert hits >= 0.9 * 10 * len(got)
    few = ann.nearest_neighbours(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, 10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") == 0, 10).count() == 0


def exact_best(x, q, members, k):
    scores = x.astype(float) @ x[q].astype(float)
    return [i for i in sorted(members, key=lambda i: (-scores[i], i)) if i != q][:k]


def test_neighbours_come_from_the_probed_lists(spark, monkeypatch):
    """The fitted sample adds no rows: with a slack that passes all, a query's rows are the best of its probed lists."""
    x = np.random.default_rng(5).normal(size=(2000, 16)).astype(np.float32)
    held, fit = [], ann.fit_index

    def few_probes(*args):
        held.append(fit(*args))
        held[-1].probes, held[-1].slack = 3, 1e6
        return held[-1]

    monkeypatch.setattr(ann, "fit_index", few_probes)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    lists = held[0].encode(x)[0]
    for q in range(0, 2000, 100):
        assert got[q] == exact_best(x, q, np.flatnonzero(np.isin(lists, held[0].probed(x[q : q + 1])[0])).tolist(), 5)


def test_neighbours_with_a_small_sample(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 5000)] + 0.3 * rng.normal(size=(5000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    hits = defaultdict(set)
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0, 10, fit_vectors=400).collect():
        hits[r.query_id].add(r.vec_id)
    assert sum(len(hits[q] & set(exact_best(x, q, range(5000), 10))) for q in range(0, 5000, 100)) >= 0.9 * 500
    # A probe that holds fewer than k is made up from other lists.
    fit = ann.fit_index

    def one_probe(*args):
        index = fit(*args)
        index.probes = 1
        return index

    monkeypatch.setattr(ann, "fit_index", one_probe)
    found = ann.nearest_neighbours(df, F.col("vec_id") % 500 == 0, 150, fit_vectors=400).groupBy("query_id").count().collect()
    assert len(found) == 10 and all(r["count"] == 150 for r in found)


def test_neighbours_among_many_near_copies(spark):
    """Codes cannot tell near copies apart, so all of them are ranked exactly."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[1000:2500] = x[1000] + 0.002 * rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 50, 10, fit_vectors=1000).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & set(exact_best(x, q, range(6000), 10))) for q in range(1050, 2500, 100)) >= 0.95 * 150
