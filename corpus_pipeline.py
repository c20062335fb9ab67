"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All stages
but the last return the columns of documents, and each works on all that its
predecessor kept.

1. Language ID drops documents that it rejects: no letter, or too far from
   every learned centroid.  It learns from the documents at hand that aren't
   held out.
2. Line dedup takes repeated and nearly repeated lines out of the texts, and
   counts ``n_chars`` anew.  No document goes; some may end up empty.
3. MinHash near-dedup keeps one row of each group, the one with the smallest
   id; a null id is kept only if its group has no other.  Rows that share an
   id, or have none, are told apart by a number written once.
4. Mixing repeats each source's documents towards its target weight.
5. SentencePiece encodes every copy and decodes it again.

Further columns don't matter, also those whose names differ from a column of
documents in case alone; an empty table gives an empty one in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelearn.llm import dart_minhash, langid, line_dedup, mixing
from tablelearn.llm.common import Scratch, take
from tablelearn.llm.queries import language_model, token_digests

COLUMNS = {c: c for c in ("doc_id", "text", "lang", "source", "n_chars")}
BROADCAST_BYTES = 8 << 20


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without those whose ``row`` is in the written table ``gone`` (column ``gone_row``).

    The numbers are broadcast only if they are few enough; else Spark joins by shuffle.
    """
    if gone.count() * 16 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["row"] == gone["gone_row"], "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = take(docs, **COLUMNS)
    model = language_model(docs)
    return langid.keep_recognised(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedupe_lines(take(docs, **COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = scratch.write(take(docs, **COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")     # orders a null id last
    found = dart_minhash.near_duplicates(docs.select(key.alias("key"), "text"), id="key")
    gone = scratch.write(found.where("not kept").select(F.col("key.row").alias("gone_row")))
    return without(docs, gone).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(take(docs, **COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(take(docs, **COLUMNS))


STAGES = [("language ID", language), ("line dedup", lines), ("near-dedup", near_copies),
          ("mixing", mix), ("SentencePiece", tokens)]

#: Language ID, fuzzy lines, MinHash and merge rounds have no SQL; tests/llm/test_pipeline.py
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and read again."""
    scratch = Scratch(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, last = scratch.write(stage(spark, docs, sf_dir)), docs
        scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
