"""The registered queries themselves, on small tables, against brute force or their SQL."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from tests.llm.conftest import frame, words
from tests.llm.test_operators import bag, brute_passages, brute_removed, brute_targets, exact_best, jaccard, labelled, split
from tidemark.llm import queries, tokens


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("sf"), random.Random(41)
    extra, labels = labelled(rng, 120)
    rows = [r for i, r in enumerate(corpus) if r[0] is not None and r[0] != 206 and r not in corpus[:i]]
    rows += [(1000 + i, t, f"s{i % 3}") for i, t in extra]
    passage = words(rng, 55, 90)  # under 400 bytes
    rows += [(2000 + i, f"{words(rng, 20)} {passage} {words(rng, 20)}", "s1") for i in range(3)]
    frame(spark, rows).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(1000 + i, y, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    urls = ["http://a.example.com/en/71", "http://example.com/en/6", "http://EXAMPLE.net/de/8?x", "http://x.org/es/", None, "nothing", "http://y.org/e", "://com/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"file://{path}/pages.parquet")
    x = np.random.default_rng(3).normal(size=(300, 8)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"file://{path}/embeddings.parquet")
    return f"file://{path}", {r[0]: r[1] for r in rows}, {r[0]: r[2] if len(r) > 2 else "a" for r in rows}, x


def run(spark, folder, name):
    assert __spark_entry__.queries()[name] is queries.QUERIES[name]
    return queries.QUERIES[name](spark, folder[0]).collect()


@functools.cache
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(text, end):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, folder):
    rows = run(spark, folder, "op1_toxicity")
    assert sorted(r.doc_id for r in rows) == sorted(folder[1])
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    toxic = {1000 + i for i in range(0, 120, 4)}
    assert {r.doc_id for r in rows if r.predicted} == toxic


def test_op2(spark, folder):
    rows = {r.doc_id: r for r in run(spark, folder, "op2_fingerprints")}
    order = sorted(folder[1], reverse=True)
    parts = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
    near = lambda a, b: sum(x == y for x, y in zip(parts(a), parts(b), strict=True)) / 64 if a and b else float(a == b)
    errors = []
    for k, i in enumerate(order):
        text, following = folder[1][i] or "", order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (folder[1][following] or "")[:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == near(r.fingerprint, r.edited_fingerprint) and r.near_next == near(r.fingerprint, rows[following].fingerprint)
        errors.append(r.near_edited - jaccard(bag(text), bag(edited)))
    assert abs(np.mean(errors)) < 0.02


def test_op3(spark, folder):
    rows = run(spark, folder, "op3_sharding")
    assert sorted(r.doc_id for r in rows) == sorted(folder[1]) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        raw = (folder[1][r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_op4(spark, folder):
    rows = run(spark, folder, "op4_suffix_array")
    texts = [(folder[1][r.doc_id] or "").encode() for r in rows]
    assert sorted(r.doc_id for r in rows) == sorted(folder[1])
    passages = brute_passages([folder[1][r.doc_id] for r in rows], 51)
    for r, t, gone, found in zip(rows, texts, brute_removed(texts, 400), passages, strict=True):
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), len(runs), hashlib.sha256(left).hexdigest())
        assert r.n_passages == len(found)
    assert {r.doc_id for r in rows if r.n_passages and not r.n_removed} >= {2000, 2001, 2002}


def test_op5(spark, folder):
    rows = run(spark, folder, "op5_packing")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in folder[1].items():
        ids, at = ids_of(text, 1), 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for own in by_sequence.values():
        ends = np.cumsum([0] + [r.length for r in sorted(own, key=lambda r: r.offset)])
        assert [r.offset for r in sorted(own, key=lambda r: r.offset)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_op6(spark, folder):
    rows = run(spark, folder, "op6_mixing")
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r.size == len(split(folder[1][r.doc_id])) and r.taken <= 3 * r.size
        sizes[folder[2][r.doc_id]] += r.size
        taken[folder[2][r.doc_id]] += r.taken
    targets = brute_targets(sizes)
    assert sorted(r.doc_id for r in rows) == sorted(folder[1])
    for r in rows:
        source = folder[2][r.doc_id]
        assert r.source_size == sizes[source] and abs(r.target - targets[source]) < 1e-6
    assert all(abs(taken[s] - t) <= 128 for s, t in targets.items())
    assert sorted(map(tuple, run(spark, folder, "op6_mixing"))) == sorted(map(tuple, rows))


@pytest.mark.parametrize(("name", "table"), [("op7_ngram_join", "documents"), ("op8_url_filters", "pages")])
def test_sql(spark, folder, name, table):
    rows = run(spark, folder, name)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder[0].removeprefix('file://')}/{table}.parquet/*.parquet'")
    found = db.sql(__spark_entry__.oracle_sql()[name])
    assert rows and sorted(found.columns) == sorted(rows[0].__fields__)
    assert sorted(tuple(str(r[c]) for c in found.columns) for r in rows) == sorted(tuple(map(str, r)) for r in found.fetchall())


def test_op8_rules_of_the_contract(spark, tmp_path):
    """The contract's own words: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    urls = {
        "http://a.com/en/x": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://a.net/de/8": ("net/de/", "allow"), "http://b.example.net/de/81": ("example.net/de/8", "block"), "http://x.org/es/": ("org/es/", "block"), "http://x.org/en/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"file://{tmp_path}/pages.parquet")
    found = run(spark, (f"file://{tmp_path}",), "op8_url_filters")
    assert [(r.rule, r.verdict) for r in sorted(found, key=lambda r: r.page_id)] == list(urls.values())


def test_op9(spark, folder):
    rows, at = {r.doc_id: r for r in run(spark, folder, "op9_token_ids")}, 0
    for i in sorted(folder[1]):
        ids = ids_of(folder[1][i], 2)
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op10(spark, folder):
    rows, x = run(spark, folder, "op10_nearest_neighbours"), folder[3]
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r.score == float(np.cumsum(x[r.query_id].astype(float) * x[r.vec_id].astype(float))[-1])
        got[r.query_id].append(r.vec_id)
    hits = sum(len(set(got[q]) & set(exact_best(x, q, range(300), 20))) for q in range(0, 300, 20))
    assert len(got) == 15 and all(len(v) == 20 for v in got.values()) and hits >= 0.9 * 300
