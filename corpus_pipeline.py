"""A corpus pipeline of five stages, each an operator of ``tidemark.llm``.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import new_folder, remove_folder, saved, small, tables_of
from tidemark.llm.mixing import mix_sources, mixed_texts
from tidemark.llm.ngram_join import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.toxicity import fit_lexicon, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.7
#: Repeated passages go from so many bytes on, and from so many words on however short these are.
PASSAGE_BYTES, PASSAGE_WORDS = 250, 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC_FROM; labels teach the lexicon and are not looked up for the decision."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score_toxicity(docs.select(*COLUMNS), fit_lexicon(docs, labels), score="_score")
    return scored.where(F.col("_score") < TOXIC_FROM).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest doc_id.

    Documents without words (null, empty or blank texts) are in no group and all stay.  A document without a doc_id is chosen
    only if its group has none with one.  Rows of one doc_id with unlike texts are documents of their own; of rows that repeat
    both doc_id and text one stays.  An empty table stays empty.
    """
    own = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    found = near_duplicates(docs.select(own.alias("doc_id"), "text"), words=5, percent=80).where("n_shingles > 0")
    found = saved(found.select(F.col("doc_id").alias("_own"), "component_id"), "grouped")
    repeated = found.groupBy("_own").agg(F.count("*").alias("n")).where("n > 1").select("_own")
    members = saved(found.distinct().join(docs.select(own.alias("_own"), "doc_id").distinct(), "_own"), "members")
    chosen = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_own"))["_own"].alias("_chosen"))
    chosen = saved(chosen, "chosen")
    gone = saved(members.join(small(chosen), "component_id").where("_own <> _chosen").select("_own").distinct(), "gone")
    again = saved(repeated.join(gone, "_own", "left_anti"), "again")
    kept = docs.select(*COLUMNS, own.alias("_own")).join(small(gone), "_own", "left_anti")
    one_each = kept.join(small(again), "_own", "left_semi").dropDuplicates(["_own"])
    return kept.join(small(again), "_own", "left_anti").union(one_each).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE_BYTES or PASSAGE_WORDS or more that also occur elsewhere; whole characters stay whole.

    Every document stays, one that consisted of such passages with an empty text.  Null and empty texts stay as they are;
    rows that repeat a text lose all of it where it is long enough; an empty table stays empty.
    """
    kept = remove_repeats(docs.select(*COLUMNS), least=PASSAGE_BYTES, least_words=PASSAGE_WORDS, whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document for each stretch of a document in an output block.

    Texts without words, null ones included, give no stretch; null is a source of its own; a null doc_id stays null; rows that
    repeat a document are documents of their own; a document that is taken three times comes in three sets of stretches; an
    empty table stays empty.
    """
    documents, pieces = mix_sources(docs.select(*COLUMNS), block_words=1024)
    pieces = mixed_texts(documents.select("row_id", "doc_id", F.col("text").alias("_whole"), "lang", "source"), pieces, text="_whole")
    return pieces.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences: one row a piece.

    A null or empty text is the end id alone; a null doc_id stays null; rows that repeat a document are packed each on its own;
    ends of equal length are packed in the order of doc_ids; an empty table gives no pieces.
    """
    pieces = pack_documents(docs.select("doc_id", "text"), tokens.default_path(), end_id=1)
    return pieces.select("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Learned scores, hashes and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again.  What a stage read, and the tables that it
    made on the way, are deleted as soon as its result is written; the result rests on the last folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        path, others = new_folder(spark, f"pipeline-{number}"), set(tables_of(spark))
        stage(spark, docs, sf_dir).write.parquet(path)
        for made in [t for t in tables_of(spark) if t not in others]:
            remove_folder(spark, made)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
