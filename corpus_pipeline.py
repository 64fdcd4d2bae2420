"""A training corpus from ``documents``: quality, lines, near duplicates, repeated passages, packing.

Every stage takes what the one before kept and returns the columns of
``documents`` (``n_chars`` follows the text); the last returns the packing, one
row a document. SQL can't express the stages, so there is none; tests hold the
pipeline against brute force.

Defined results: rows with null or empty texts go through every stage like
others (all empty texts are near duplicates of each other, so one stays); near
duplicates are linked by their texts alone, so rows that share an id, or have
none, stay when their texts differ; of a group the row with the smallest id stays
(none counts as the smallest; of rows that share it, that with the smallest hash of
the text; of rows that repeat both, one, with the other columns that come first as
JSON); a row whose text is removed entirely by a later stage stays with an empty
text; texts of any length are read whole; an empty table gives an empty result;
further columns are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import doc_keys, new_texts, stash, table
from stocktake.llm.jaccard import jaccard_components
from stocktake.llm.line_dedup import line_dedup
from stocktake.llm.packing import pack
from stocktake.llm.quality import accepted
from stocktake.llm.suffix_dedup import suffix_dedup

#: Near duplicates: five-word shingles, linked at a Jaccard similarity of 0.8 (``jaccard.LEAST``).
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return new_texts(docs, line_dedup(docs, carry=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash finds candidates, exact similarity decides; of each component the row with the smallest id stays."""
    rows = jaccard_components(docs, SHINGLE)
    one = stash(rows.groupBy("component").agg(F.min(F.struct("did", "rid")).alias("keep"), F.count("*").alias("n")).select("keep.*", "n"), "kept")
    kept = doc_keys(docs, carry=True).join(one.hint("merge"), ["did", "rid"])
    # a row can only be repeated where its component has several; those are few and meet by their key
    single, several = kept.where("n = 1"), kept.where("n > 1")
    first = several.groupBy("did", "rid", "text").agg(F.min_by("row", F.to_json("row")).alias("row"))
    left = single.select("text", "row").union(first.select("text", "row"))
    return left.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return new_texts(docs, suffix_dedup(docs, carry=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).select("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", passages),
    ("packing", packing),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
