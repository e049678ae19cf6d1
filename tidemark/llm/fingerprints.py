"""Document fingerprints by consistent weighted sampling, with DataFrame functions alone.

A document is a bag of word shingles, each weighing as often as it occurs.  For each of SAMPLES draws every shingle gets
two Gamma(2, 1) numbers r and c and a uniform b that depend on the shingle and the draw alone; with weight S,
t = floor(ln S / r + b) and a = c * exp(-r * (t + 1 - b)).  The smallest a of a document is its sample.  Two documents share
a sample with a chance equal to their generalised Jaccard similarity, the sum of the smaller weights over that of the larger.

The gamma numbers are built from three exponentials e1, e2, e3: c = e1 + e2, r = ln(c / e1) + e3, b = e3 / r, which have
exactly that joint law.  Where t = 0, so for every shingle that occurs once, a is e1 itself, and no logarithm is needed: the
smallest e1 belongs to the largest of the uniform numbers it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved, small, uniform

SHINGLE_WORDS, SAMPLES = 5, 64
#: Samples computed side by side for one row, and documents in one stretch of ids.
_LANE, BUCKET_DOCS = 16, 1024
#: Parts that the order of all documents is cut into by bounds in the plan, parts of each of those by bounds in a small table,
#: and sampled documents for each bound.
COARSE, FINE, OVERSAMPLE = 1024, 1024, 16
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def weighted_shingles(df: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds an array of (h, w): the 64-bit hash of each distinct shingle and how often it occurs.

    Words are runs of characters other than ASCII white space.  A text of fewer words is one shingle; one without words
    has none.
    """
    trimmed = F.expr(f"btrim({text}, {_SPACE})")
    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    df = df.withColumn("_words", F.transform(split, lambda w: F.xxhash64(w)))
    at = [lambda i, k=k: F.get("_words", i + k) for k in range(words)]
    runs = F.transform(F.sequence(F.lit(0), F.size("_words") - words), lambda i: F.xxhash64(*[a(i) for a in at]))
    few = F.when(F.size("_words") > 0, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_terms", F.when(F.size("_words") >= words, runs).otherwise(few)).drop("_words")
    once = F.size(F.array_distinct("_terms")) == F.size("_terms")
    df = df.withColumns({"_once": once, "_terms": F.when(once, F.col("_terms")).otherwise(F.sort_array("_terms"))})
    first = F.filter(F.sequence(F.lit(0), F.size("_terms") - 1), lambda i: (i == 0) | (F.get("_terms", i) != F.get("_terms", i - 1)))
    df = df.withColumn("_first", F.when(~F.col("_once"), first))
    singles = F.transform("_terms", lambda h: F.struct(h.alias("h"), F.lit(1).alias("w")))
    counted = F.transform("_first", lambda p, j: F.struct(F.get("_terms", p).alias("h"), (F.coalesce(F.get("_first", j + 1), F.size("_terms")) - p).alias("w")))
    return df.withColumn(out, F.when(F.col("_once"), singles).otherwise(counted)).drop("_terms", "_first", "_once")


def _samples(df: DataFrame, keys: list[str], terms: str, n: int, extra: list[Column]) -> DataFrame:
    """For each row of ``keys`` and each lane ``_j`` the array ``_m`` of its samples, each the largest 63-bit number.

    Shingles that occur once take a row for each lane of _LANE samples, others a row for each sample.  ``extra`` replaces
    the samples where its first column is not null.
    """
    lanes = n // _LANE
    df = df.select(*keys, *extra, F.inline_outer(terms))
    many = F.col("w") > 1
    lane = F.explode(F.when(many, F.lit(list(range(lanes, lanes + n)))).otherwise(F.lit(list(range(lanes)))))
    df = df.withColumn("_lane", lane)
    single = F.col("_lane") >= lanes
    k = F.when(single, F.col("_lane") - lanes).otherwise(F.lit(0))
    df = df.withColumn("_k", k)

    def bits(*more: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64("h", "_k", *more), 1)

    def exponential(number: Column) -> Column:
        return -F.log((number.cast("double") + 0.5) / float(1 << 63))

    df = df.withColumn("_v0", F.when(single, bits()))
    df = df.withColumns(
        {"_e1": F.when(single, exponential(F.col("_v0"))), "_e2": F.when(single, exponential(bits(F.lit(1)))), "_e3": F.when(single, exponential(bits(F.lit(2))))}
    )
    df = df.withColumn("_lnc", F.when(single, F.log(F.col("_e1") + F.col("_e2"))))
    df = df.withColumn("_r", F.when(single, F.col("_lnc") - F.log("_e1") + F.col("_e3")))
    df = df.withColumn("_t", F.when(single, F.floor((F.log(F.col("w").cast("double")) + F.col("_e3")) / F.col("_r"))))
    later = F.exp(-F.exp(F.col("_lnc") - F.col("_r") * (F.col("_t") + 1) + F.col("_e3"))) * float(1 << 63)
    df = df.withColumn("_v", F.when(F.col("_t") == 0, F.col("_v0")).otherwise(F.when(single, F.least(later, F.lit(float((1 << 63) - 1024))).cast("long"))))
    best = []
    for i in range(_LANE):
        fast = F.when(F.col("h").isNotNull(), F.shiftrightunsigned(F.xxhash64("h", F.col("_lane") * _LANE + i), 1))
        value = F.when(single, F.when(F.col("_k") % _LANE == i, F.col("_v"))).otherwise(fast)
        if i + 1 < len(extra):
            value = F.when(F.col("_x0").isNotNull(), F.col(f"_x{i + 1}")).otherwise(value)
        best.append(F.max(value).alias(f"_m{i}"))
    j = F.when(single, F.floor(F.col("_k") / _LANE).cast("int")).otherwise(F.col("_lane"))
    return df.withColumn("_j", j).groupBy(*keys, "_j").agg(*best).select(*keys, "_j", F.array(*[f"_m{i}" for i in range(_LANE)]).alias("_m"))


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples; 1 for two documents without words, 0 for one."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: same)) / F.lit(float(n))


def shortened(samples: Column) -> Column:
    """32 bits of each sample: what a fingerprint consists of, and what fingerprints are compared by."""
    return F.transform(samples, lambda v: F.shiftright(v, 16).bitwiseAND(F.lit(0xFFFFFFFF)))


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits for each of a fingerprint's samples; empty for a document without words."""
    digits = F.transform(samples, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0"))
    return F.array_join(digits, "")


def fingerprint(df: DataFrame, key: str, text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``key``, ``samples`` (array of long) and ``fingerprint`` of every row; rows that share a key count as one text each
    only if ``key`` tells them apart, so it must.  A null text is empty and has the fingerprint of no words."""
    slim = weighted_shingles(df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text", "_bag")
    lanes = _samples(slim, ["_key"], "_bag", samples, [])
    whole = lanes.groupBy("_key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_j", "_m"))), lambda s: s["_m"])).alias("samples"))
    return whole.select(F.col("_key").alias(key), shortened(F.col("samples")).alias("samples")).withColumn("fingerprint", as_text(F.col("samples")))


def _quantiles(rows: Column, parts: Column) -> Column:
    """The bounds between so many parts of sorted rows: none for one part."""
    return F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), lambda j: F.get(rows, F.floor(j * F.size(rows) / parts).cast("int"))))


def _at_or_below(bounds: Column, size: int, key: Column) -> Column:
    """How many of at most ``size`` sorted bounds are at or below the key, by binary search; 0 without bounds."""
    steps = F.lit([1 << s for s in reversed(range(size.bit_length()))])
    fits = lambda at: F.coalesce(F.get(bounds, at - 1) <= key, F.lit(False))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda low, step: F.when(fits(low + step), low + step).otherwise(low)), F.lit(0))


def _in_stretches(base: DataFrame, bucket_docs: int) -> DataFrame:
    """Adds ``_b``, the number of the stretch of the order by (_k, _h) that a row lies in; numbers rise with the order.

    Bounds come from samples that depend on keys alone: those of COARSE parts go into the plan, those of FINE parts of each
    part into a table of so many rows that is broadcast.  So there are up to a million stretches, which no array, list of rows
    or task holds all of; beyond that stretches grow, and are sorted with spilling.
    """
    n = base.count()
    wanted = max(1, n // bucket_docs)
    coarse, key = min(COARSE, wanted), F.struct("_k", "_h")
    drawn = uniform("_k", "_h", seed=5)
    part = F.lit(0)
    if coarse > 1:
        rows = base.where(drawn <= min(1.0, 4 * OVERSAMPLE * coarse / n)).agg(F.sort_array(F.collect_list(key)).alias("_s"))  # some 64 numbers a bound
        bounds = rows.select(_quantiles(F.col("_s"), F.lit(coarse)).alias("_q")).first()[0]
        # Compared as pairs: a literal array of each number.
        ks, hs = F.lit([b["_k"] for b in bounds]), F.lit([b["_h"] for b in bounds])
        steps = F.lit([1 << s for s in reversed(range(len(bounds).bit_length()))])
        fits = lambda at: F.coalesce((F.get(ks, at - 1) < F.col("_k")) | ((F.get(ks, at - 1) == F.col("_k")) & (F.get(hs, at - 1) <= F.col("_h"))), F.lit(False))
        part = F.aggregate(steps, F.lit(0), lambda low, step: F.when(fits(low + step), low + step).otherwise(low))
    if wanted <= COARSE:
        return base.withColumn("_b", part.cast("long"))
    base = base.withColumn("_part", part)
    parts = F.least(F.lit(FINE), F.greatest(F.lit(1), F.floor(F.col("_n") / bucket_docs))).cast("int")
    sample = F.when(drawn <= min(1.0, OVERSAMPLE / bucket_docs, OVERSAMPLE * FINE * coarse / n), key)
    table = base.groupBy("_part").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(sample)).alias("_s"))
    table = saved(table.select("_part", _quantiles(F.col("_s"), parts).alias("_q")), "bounds")  # COARSE rows
    fine = _at_or_below(F.col("_q"), FINE, key)
    return base.join(F.broadcast(table), "_part").withColumn("_b", F.col("_part").cast("long") * (2 * FINE) + fine).drop("_part", "_q")


def edited_fingerprints(docs: DataFrame, *, samples: int = SAMPLES, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Fingerprints of every document and of its text with the second half taken from the next document.

    Documents (``doc_id``, ``text``) follow each other by descending doc_id, null last, and the first follows the last; of
    equal doc_ids the order is that of the texts' hashes.  Returns doc_id, n_chars, edited (text's sha-256), own and other
    (samples), next (samples of the next document).

    Stretches of the order of about ``bucket_docs`` documents are laid side by side by one shuffle of the texts, on which all
    that follows rests; each gets a copy of the document that its last one is followed by.  A null doc_id counts as the
    smallest; a doc_id that very many rows share is cut by texts' hashes.  A null text is empty; repeated rows are documents
    of their own; an empty table gives an empty result; other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_h": F.xxhash64("text")})
    base = _in_stretches(base, bucket_docs)
    # The last document of each stretch, which follows the next stretch's first; one row a stretch.
    ends = saved(base.groupBy("_b").agg(F.max(F.struct("_k", "_h")).alias("_end")), "ends")
    every = Window.partitionBy(F.lit(0)).orderBy("_b")
    after = F.coalesce(F.lead("_b").over(every), F.min("_b").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    links = small(saved(ends.select(F.col("_b").alias("_of"), "_end._k", "_end._h", after.alias("_to")), "links"))
    copies = base.withColumnRenamed("_b", "_of").join(links, ["_of", "_k", "_h"]).select("doc_id", "text", "_k", "_h", F.col("_to").alias("_b")).dropDuplicates(["_b"])
    rows = base.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))

    order = Window.partitionBy("_b").orderBy(F.desc("_copy"), "_k", "_h")
    rows = rows.withColumns({"_rn": F.row_number().over(order), "_next": F.lag("text").over(order)})
    rows = rows.withColumn("_n", F.length("text").cast("long"))
    edited = F.concat(F.expr("substring(text, 1, cast(_n - floor(_n / 2) as int))"), F.expr("substring(_next, 1, cast(floor(_n / 2) as int))"))
    rows = rows.withColumn("_edited", F.when(F.col("_copy") == 0, edited).otherwise(""))
    sha = F.sha2("_edited", 256)
    # What else a document has travels with it as numbers, in a row of its own beside the samples.
    numbers = [F.conv(F.substring("_sha", 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)] + [F.col("_n"), F.col("doc_id").cast("long"), F.col("_copy").cast("long")]
    rows = rows.withColumn("_sha", sha).select("_b", "_rn", "text", "_edited", *[x.alias(f"_x{i + 1}") for i, x in enumerate(numbers)])
    either = F.array(
        *[F.struct(F.lit(i).alias("_which"), x.alias("_text")) for i, x in enumerate((F.col("text"), F.col("_edited"), F.lit("")))]
    )
    carried = [f"_x{i + 1}" for i in range(len(numbers))]
    rows = rows.select("_b", "_rn", *carried, F.inline(either))
    rows = weighted_shingles(rows, "_text", "_bag").withColumn("_x0", F.when(F.col("_which") == 2, F.lit(1)))
    lanes = _samples(rows, ["_b", "_rn", "_which"], "_bag", samples, [F.col("_x0"), *[F.col(c) for c in carried]])
    whole = lanes.groupBy("_b", "_rn").agg(F.sort_array(F.collect_list(F.struct("_which", "_j", "_m"))).alias("_all"))

    def of(which: int) -> Column:
        return F.flatten(F.transform(F.filter("_all", lambda s: s["_which"] == which), lambda s: s["_m"]))

    whole = whole.select("_b", "_rn", shortened(of(0)).alias("own"), shortened(of(1)).alias("other"), of(2).alias("_meta"))
    whole = whole.withColumn("next", F.lag("own").over(Window.partitionBy("_b").orderBy("_rn")))
    sha_text = F.concat(*[F.lpad(F.lower(F.hex(F.get("_meta", F.lit(i)))), 16, "0") for i in range(4)])
    return whole.where(F.get("_meta", F.lit(6)) == 0).select(
        F.get("_meta", F.lit(5)).alias("doc_id"), F.get("_meta", F.lit(4)).alias("n_chars"), sha_text.alias("edited_sha256"), "own", "other", "next"
    )
