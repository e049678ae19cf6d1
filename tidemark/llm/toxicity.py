"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, modest_batches, saved
from tidemark.llm.shingles import give_back

#: Labelled documents of each class that a fit reads at most (those with the smallest hash of doc_id).
FIT_DOCS = 10_000
#: Letters of word beginnings that can become lexicon entries; longer words can become entries as a whole.
SHORTEST, LONGEST = 3, 12
#: Documents of its class that an entry or an exception needs, how many times its rate has to be that in the other class, and
#: the evidence (twice the log-likelihood ratio) an entry needs beside twice the logarithm of how many were tried.
LEAST_DOCS, LEAST_RATIO, EXCEPTION_RATIO, EVIDENCE = 3, 5.0, 2.0, 10.0
#: Word beginnings that a task counts before it gives its counts away.
_COUNTED = 150_000

# Look-alikes of Latin letters in other scripts, and digits or signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i",
}


class _Folding(dict):
    """Character by character: lower case, compatibility form, no accents, look-alikes replaced."""

    def __missing__(self, code: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        out = "".join(HOMOGLYPHS.get(c, c) for c in plain)
        self[code] = out
        return out


_folding = _Folding()
_word = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.translate(_folding)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of the folded text."""
    return _word.findall(fold(text))


@dataclass
class Lexicon:
    """Weighted word beginnings, phrases in which they do not count, and the calibration of the score."""

    terms: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    cut: float = 0.5
    scale: float = 1.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        """Terms and exception phrases in one Aho-Corasick automaton; both begin with the blank ahead of a word."""
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            for term, weight in self.terms.items():
                a.add_word(f" {term}", (len(term) + 1, weight))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def weight(self, text: str) -> tuple[float, int]:
        """(weight of all matches, words).  A match starts a word; inside an exception phrase of whole words it does not count."""
        a, total = self.automaton(), 0.0
        words = words_of(text)
        if not len(a) or not words:
            return total, len(words)
        hits, safe = [], []
        for last, (size, weight) in a.iter(f" {' '.join(words)} "):
            if weight is None:
                safe.append((last - size + 1, last))
            else:
                hits.append((last - size + 1, last, weight))
        at, until = 0, -1  # phrases are merged in the order of their starts
        safe.sort()
        hits.sort()
        for first, last, weight in hits:
            while at < len(safe) and safe[at][0] <= first:
                until = max(until, safe[at][1])
                at += 1
            if last > until:
                total += weight
        return total, len(words)

    def density(self, text: str) -> float:
        """Weight for the text's length, on a scale that grows slowly: log(1 + weight per hundred words, and weight)."""
        weight, words = self.weight(text)
        return math.log1p(100 * weight / (words + 20)) if weight > 0 else 0.0

    def score(self, text: str | None) -> float:
        """0 to 1; 0.7 at the cut between the classes."""
        x = self.scale * (self.density(text or "") - self.cut) + math.log(0.7 / 0.3)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _starts(words: list[str]) -> Counter[str]:
    """How often each word beginning occurs, and each whole word that is longer."""
    out: Counter[str] = Counter()
    for word, n in Counter(words).items():
        for k in range(SHORTEST, min(LONGEST, len(word)) + 1):
            out[word[:k]] += n
        if len(word) > LONGEST:
            out[word] += n
    return out


def _phrases(words: list[str], holds) -> Counter[str]:
    """How often each word with an entry occurs, and each phrase of two or three words around one."""
    out: Counter[str] = Counter()
    for i, word in enumerate(words):
        if holds(word):
            for a, b in ((i, i + 1), (i - 1, i + 1), (i, i + 2), (i - 1, i + 2), (i - 2, i + 1), (i, i + 3)):
                if a >= 0 and b <= len(words):
                    out[" ".join(words[a:b])] += 1
    return out


@dataclass
class Count:
    """Occurrences of a term, and documents that hold it, in each class."""

    term: str
    toxic: int
    clean: int
    toxic_docs: int
    clean_docs: int


def _evidence(mine: Column, other: Column, mine_all: int, other_all: int) -> Column:
    """Twice the log-likelihood ratio that the term's rate differs between classes of so many words."""
    share = mine_all / (mine_all + other_all)
    n = mine + other

    def part(k: Column, p: float) -> Column:
        return F.when(k > 0, k * F.log(k / (n * F.lit(p)))).otherwise(0.0)

    return 2 * (part(mine, share) + part(other, 1 - share))


def _telling(counts: DataFrame, total: Count, mine: str, other: str, ratio: float, needed: float) -> DataFrame:
    """Rows of terms that are commoner in the class ``mine`` than in the other, with ``odds`` (log ratio of rates) and ``evidence``."""
    m, o = max(1, getattr(total, mine)), max(1, getattr(total, other))
    odds = F.log((F.col(mine) + 0.1) / F.lit(float(m + 1))) - F.log((F.col(other) + 0.1) / F.lit(float(o + 1)))
    found = counts.withColumns({"odds": odds, "evidence": _evidence(F.col(mine), F.col(other), m, o)})
    return found.where((F.col(f"{mine}_docs") >= LEAST_DOCS) & (F.col("odds") >= math.log(ratio)) & (F.col("evidence") >= needed))


def choose_terms(telling: Iterable[tuple[str, float, float]]) -> dict[str, float]:
    """Of terms (term, odds, evidence) that continue each other the one with the most evidence, the longest where equal; the
    weight is the log-odds of the rates."""
    chosen: dict[str, float] = {}
    within: set[str] = set()
    for term, odds, _ in sorted(telling, key=lambda x: (-x[2], -len(x[0]), x[0])):
        if term not in within and not any(term[:k] in chosen for k in range(SHORTEST, len(term))):
            chosen[term] = odds
            within.update(term[:k] for k in range(SHORTEST, len(term) + 1))
    return chosen


def calibrate(lexicon: Lexicon, toxic: np.ndarray, clean: np.ndarray) -> None:
    """Set the cut where the rates of errors in the two classes sum to least, in the middle of the gap there."""
    if not len(toxic) or not len(clean):
        lexicon.cut, lexicon.scale = (0.5, 4.0)
        return
    values = np.unique(np.concatenate([toxic, clean]))
    cuts = np.concatenate([[values[0] - 0.1], (values[1:] + values[:-1]) / 2, [values[-1] + 0.1]])
    missed = np.searchsorted(np.sort(toxic), cuts) / len(toxic)
    wrong = 1 - np.searchsorted(np.sort(clean), cuts) / len(clean)
    best = missed + wrong
    lexicon.cut = float(np.median(cuts[best == best.min()]))
    lexicon.scale = 4.0 / max(0.1, float(np.median(toxic)) - lexicon.cut)


COUNTS = ("toxic", "clean", "toxic_docs", "clean_docs")


def _counted(texts: DataFrame, terms_of) -> DataFrame:
    """How often the terms of texts occur in each class, and in how many texts: term and COUNTS, and a row for the term "" that has the
    words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[Counter] = [Counter(), Counter()]
        in_docs: list[Counter] = [Counter(), Counter()]

        def so_far() -> Iterator[pa.RecordBatch]:
            terms = list(words[0].keys() | words[1].keys())
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                columns = [[c[s] for s in some] for c in (words[1], words[0], in_docs[1], in_docs[0])]
                yield pa.record_batch([some, *columns], ["term", *COUNTS])
            for c in (*words, *in_docs):
                c.clear()

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = words_of(text.as_py())
                found = terms_of(own)
                found[""] = len(own)
                words[y].update(found)
                in_docs[y].update(found.keys())
                if len(words[0]) + len(words[1]) > _COUNTED:
                    yield from so_far()
        yield from so_far()
        give_back()

    schema = "term string, " + ", ".join(f"{c} long" for c in COUNTS)
    return saved(texts.mapInArrow(count, schema).groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS]), "terms")


def fit_lexicon(docs: DataFrame, labels: DataFrame, *, fit_docs: int = FIT_DOCS) -> Lexicon:
    """Learn a lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    Reads at most ``fit_docs`` labelled documents of each class, those with the smallest hash of doc_id, one text each (the
    smallest, where rows repeat a doc_id); their ids are bounded by that and are broadcast.  Entries are word beginnings that
    are surely commoner in toxic documents, however rare they are; exceptions are words and phrases of two or three words
    around an entry that are commoner in clean ones.  Counts are made by the executors and summed; what tells the classes
    apart, again bounded by the sample, comes to the driver.  Null ids, labels or texts take no part.  With one class missing
    the lexicon is empty and every text scores alike.
    """
    modest_batches(docs.sparkSession)
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    bounded = [labels.where(F.col("toxic") == y).orderBy(*by_hash).limit(fit_docs) for y in (1, 0)]
    # A table and not rows from the driver, for which Spark keeps a second set of Python workers beside that of the functions.
    sample = saved(bounded[0].union(bounded[1]), "sample")
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    texts = saved(texts.select("text", "toxic").distinct().repartition(max(1, 2 * docs.sparkSession.sparkContext.defaultParallelism)), "labelled")

    summed = _counted(texts, _starts)
    total = Count(*(summed.where("term = ''").first() or ("", 0, 0, 0, 0)))
    lexicon, phrases = Lexicon({}), None
    if total.toxic and total.clean:
        needed = EVIDENCE + 2 * math.log(summed.count())
        found = _telling(summed.where("term <> ''"), total, "toxic", "clean", LEAST_RATIO, needed).select("term", "odds", "evidence").collect()
        lexicon.terms = choose_terms(tuple(r) for r in found)
    if lexicon.terms:
        terms = frozenset(lexicon.terms)

        def holds(word: str) -> bool:
            return any(word[:k] in terms for k in range(SHORTEST, min(LONGEST, len(word)) + 1)) or word in terms

        phrases = _counted(texts, lambda words: _phrases(words, holds))
        clean = _telling(phrases.where("term <> ''"), total, "clean", "toxic", EXCEPTION_RATIO, 0.0).select("term").collect()
        lexicon.exceptions = {r.term for r in clean}

    @F.pandas_udf("double")
    def density(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lexicon.density).astype(float)

    seen = [(r[0], r[1]) for r in texts.select("toxic", density("text")).collect()]
    calibrate(lexicon, np.array([d for y, d in seen if y == 1]), np.array([d for y, d in seen if y == 0]))
    for table in (sample, texts, summed, phrases):
        discard(table)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", score: str = "score") -> DataFrame:
    """Every row with a column ``score`` (0 to 1, higher: likelier toxic); a column of that name is replaced.

    Whole texts are read.  A null or empty text holds no entry and scores like any text without one.  The lexicon is
    bounded by the sample it was learned from, and goes to the tasks with the function.  Rows are judged one by one, so
    ties, repeated rows and other columns play no part; an empty table gives an empty result.
    """
    modest_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([lexicon.score(t) for t in part], dtype="float64")
        give_back()

    return docs.withColumn(score, scored(F.coalesce(F.col(text), F.lit(""))))
