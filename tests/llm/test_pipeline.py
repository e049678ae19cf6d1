"""The pipeline's stages on a small corpus, each against brute force, and the run of all."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as P
from tests.llm.conftest import frame, words
from tests.llm.test_operators import brute_components, brute_removed, brute_targets, labelled, split
from tidemark.llm import tokens
from tidemark.llm.common import tables_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    rows, labels = labelled(rng, 160)
    passage = words(rng, 90)
    rows += [(i, f"{words(rng, 40)} {passage}\n{words(rng, 40)}", "b") for i in range(200, 206)]
    rows += [(i, rows[1][1], "b") for i in range(300, 304)]
    near = words(rng, 100).split()
    rows += [(400 + k, " ".join(near[:k] + ["x"] + near[k + 1 :]), "c") for k in (5, 50, 95)]
    rows += [(500, None, "b"), (501, "", None), (502, " ", "b"), (None, "no number here", "c"), (503, "twice", "c"), (503, "twice", "c")]
    path = tmp_path_factory.mktemp("sf")
    frame(spark, rows).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What goes into each stage and what the last gives."""
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in P.STAGES:
        seen.append(docs.collect())
        path = f"file://{tmp_path_factory.mktemp('stage')}/out"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if stage is not P.pack:
            assert tuple(docs.columns) == P.COLUMNS
    return [*seen, docs.collect()]


def test_stages_are_the_five():
    assert [name for name, _ in P.STAGES] == ["toxicity", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "packing"]
    assert __spark_entry__.queries()["pipeline"] is P.run


def test_toxic_go_and_clean_stay(stages):
    before, after = (Counter(r.doc_id for r in s) for s in stages[:2])
    assert before - after == Counter({i: 1 for i in range(0, 160, 4)})


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    rows = [(r.doc_id, r.text) for r in before]
    components = brute_components(rows, 5, 80)
    kept = Counter((i, t) for (i, t), (_, n, low) in zip(rows, components, strict=True) if i is None or n == 0 or i == low)
    assert kept[503, "twice"] == 2  # rows that repeat both are one group, of which one stays
    kept[503, "twice"] = 1
    assert Counter((r.doc_id, r.text) for r in after) == kept
    assert {400, 405, 450, 495} & {r.doc_id for r in after} == {405} and not {300, 301, 302, 303} & {r.doc_id for r in after}


def test_passages_go(stages):
    before, after = stages[2], {r.doc_id: r for r in stages[3]}
    gone = brute_removed([(r.text or "").encode() for r in before], P.PASSAGE_BYTES)
    assert len(stages[3]) == len(before) and sum(map(sum, gone)) > 2000
    for r, g in zip(before, gone, strict=True):
        own = after[r.doc_id]
        expected = None if r.text is None else bytes(np.frombuffer(r.text.encode(), np.uint8)[~g]).decode()
        assert own.text == expected and own.n_chars == (None if expected is None else len(expected))


def test_mixture_meets_its_targets(stages):
    sizes, taken, whole = Counter(), Counter(), defaultdict(list)
    for r in stages[3]:
        sizes[r.source] += len(split(r.text))
        whole[r.doc_id].append(split(r.text))
    for r in stages[4]:
        w = split(r.text)
        taken[r.source] += len(w)
        assert any(w == own[i : i + len(w)] for own in whole[r.doc_id] for i in range(len(own))) and r.n_chars == len(r.text)
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= 1024, source


def test_packing_keeps_every_token(stages):
    whole = Tokenizer.from_file(tokens.default_path())
    expected = Counter()
    for r in stages[4]:
        expected[r.doc_id] += len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed, fill = Counter(), Counter()
    for r in stages[5]:
        packed[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert packed == expected and max(fill.values()) <= 2048


def test_run_applies_all(spark, folder, stages):
    before = set(tables_of(spark))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.start, r.length, bytes(r.ids))
    assert sorted(map(key, P.run(spark, folder).collect())) == sorted(map(key, stages[5]))
    assert set(tables_of(spark)) == before


def test_empty_tables(spark):
    docs = frame(spark, []).select(*P.COLUMNS)
    for stage in (P.drop_near_duplicates, P.drop_repeated_passages, P.mix, P.pack):
        assert stage(spark, docs, "").count() == 0


def test_passages_of_short_words_go(spark):
    """Over fifty words in fewer than 250 bytes go; fifty words stay, and so do two shorter repeats side by side."""
    rng = random.Random(11)
    short = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzäö") + rng.choice("abcdefghijklmnop") for _ in range(n))
    own = lambda: " " + words(rng, 30) + " "
    long, fifty, one, two = short(51), short(50), short(40), short(40)
    pieces = {i: (own(), own()) for i in range(8)}
    texts = [long, long, fifty, fifty, f"{one} {two}", one, two]
    rows = [(i, pieces[i][0] + t + pieces[i][1]) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in P.drop_repeated_passages(spark, frame(spark, rows), "").collect()}
    assert len(long.encode()) < P.PASSAGE_BYTES
    for i, text in rows:
        assert got[i] == (text.replace(long, "") if i < 2 else text)


def test_no_copy_without_an_id_stays_beside_its_group(spark):
    rng = random.Random(12)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(7, a), (7, a), (None, a), (None, a + " more"), (None, b), (None, b), (None, b + " more"), (5, c), (5, a), (None, ""), (None, None), (9, "")]
    got = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, frame(spark, rows), "").collect()]
    assert len([t for _, t in got if t and t.startswith(b)]) == 1
    assert Counter(r for r in got if not (r[1] or "").startswith(b)) == Counter([(5, a), (5, c), (None, ""), (None, None), (9, "")])
