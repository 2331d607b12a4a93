"""The corpus pipeline: documents through five stages, each written as Parquet and reread.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, ties, empty tables and further
columns, which it drops: what these give is said by each stage and by the operator that it calls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import bpe, cotraining, jaccard, line_dedup, mixing
from lodegraph.llm.common import Scratch, apart, bit_table, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject. Without labels of both kinds all stay."""
    return cotraining.scored(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut from the texts; documents that these were all of go. Others stay, also those
    of null or empty text."""
    cleaned = line_dedup.without_repeats(docs)
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == "", F.lit(False))
    return _documents(cleaned.where(~((F.col("n_lines_removed") > 0) & blank)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose sets of five-word shingles link at a similarity of 0.8 or more, directly or over others, one stays: that
    of the least id, null ids last, then of the least hash of its columns. It is rows that are chosen, so of two texts under
    one id one may stay, and of equal rows one does. Texts without words link with nothing and stay. Only rows that may go
    are shuffled."""
    scratch = Scratch(spark)
    mark = F.xxhash64(*COLUMNS)
    found = jaccard.classes(docs, k=5, num=80, den=100, mark=mark).where("group is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    best = found.groupBy("group").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups = scratch.save(found.join(best, "group").select(order.alias("own"), "best"), "groups")
    gone = groups.where("own != best").select("own.*").distinct()
    twice = groups.where("own = best").groupBy("own").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("own.*")
    gone, twice = scratch.save(gone, "gone"), scratch.save(twice, "twice")
    field = bit_table(gone.select("mark").unionByName(twice.select("mark")), scratch, "field")
    near, rest = apart(docs.select(*COLUMNS).withColumn("__mark", mark), F.col("__mark"), field)
    same = lambda t: (F.col("__mark") == t["mark"]) & F.col("doc_id").isNull().eqNullSafe(t["last"]) & (F.coalesce("doc_id", F.lit(0)) == t["id"])
    left = near.join(gone, same(gone), "left_anti")
    once = left.join(twice, same(twice), "left_semi").dropDuplicates(list(COLUMNS))
    return rest.unionByName(left.join(twice, same(twice), "left_anti")).unionByName(once).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; of null and empty texts as often as their source's epochs."""
    mixed = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    return mixed.where("times > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, times)"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their count and digest, and the decoded bytes' digest."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", encoding),
]
#: The classifier, the hashes' order and the merges are beyond SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written and reread, and the one before it deleted."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
