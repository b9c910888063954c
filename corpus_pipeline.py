"""The corpus pipeline: quality filter, exact dedup, near dedup, source mix, tokens.

Every stage works on any table with the columns of documents; further columns, whatever their names, are
dropped. An empty table gives an empty result. Null texts are empty: quality keeps them, exact dedup
keeps one of them, they link with nothing. Decisions hold for rows, not for ids: where ids are null or
repeat, a row is told from others by its id and text together, so a rejected row takes no other with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.functions.storage import checked_broadcast, cut, dropped
from voxelweave.llm import bpe, exact_dedup, mixing, near_dedup, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Keys of rows whose id is null or repeats start here, above all ids.
OWN_KEYS = 1 << 62


def _keyed(docs: DataFrame) -> DataFrame:
    """docs' COLUMNS with `row`: the id where it belongs to one row only, else a hash of id and text. Rows
    that agree in both are one document. Only ids are grouped; repeated ones are broadcast after a
    size check."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    again = checked_broadcast(cut(ids.where("doc_id is not null and rows > 1").select(F.col("doc_id").alias("again")), "again"))
    own = F.lit(OWN_KEYS) + F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 3)
    marked = docs.select(*COLUMNS).join(again, F.col("doc_id") == F.col("again"), "left")
    return marked.select(*COLUMNS, F.when(F.col("doc_id").isNull() | F.col("again").isNotNull(), own).otherwise(F.col("doc_id")).alias("row"))


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of docs (with row) that judged (row, kept) does not reject; few rejections are broadcast after a
    size check, many are joined with a shuffle."""
    bad = checked_broadcast(cut(judged.where("not kept").select("row").distinct(), "rejected"))
    return docs.join(bad, "row", "left_anti").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps; equal rows share a verdict."""
    rows = _keyed(docs)
    return _without(rows, quality.classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("row",)))


def _text_key(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts those with the largest id; a null id stays only if all are null. Repeats of the
    winning row all stay here: the mix treats them as separate documents."""
    bad = exact_dedup.exact_dedup(docs, keep="largest").where("not kept").select(F.col("doc_id").alias("id"), _text_key(F.col("text_sha256")).alias("key"))
    bad = checked_broadcast(cut(bad.distinct(), "rejected"))
    key = _text_key(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.select(*COLUMNS).join(bad, F.col("doc_id").eqNullSafe(F.col("id")) & (key == F.col("key")), "left_anti")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; rows with a null or repeated id come after
    all others, in the order of a hash."""
    rows = _keyed(docs)
    return _without(rows, near_dedup.near_duplicates(rows, id_col="row").select(F.col("doc_id").alias("row"), "kept"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's weight says; repeated rows and null ids are documents of their own."""
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row and their text, as digests; one result a row."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mix_stage),
    ("byte-level BPE", bpe_stage),
]

#: SQL cannot express the quality model; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again, and removed once the
    next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        after = cut(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            dropped(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
