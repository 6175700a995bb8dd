"""A corpus pipeline over ``documents``: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's
rows as Parquet to the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import mixing, pieces, quality, secrets, simhash
from strata.llm.common import cut, drop_cut, table

#: tokens of a domain after mixing, in times of what it has; rates are 1 and more, so that no document is lost
LIFTS = {"low": 1.0, "low_toxic": 1.0, "good": 1.1, "good_toxic": 1.0}


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null text counts as empty; rows repeat as they came; all columns stay. Without labels every document is kept (a score
    of one half). An empty table gives an empty table.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, columns=docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: of those with the smallest id, if any has one, the first.

    Rows are told apart by a key of their own, so that rows of one id with several texts, repeated rows and rows without an
    id are each judged by their text. Null texts are one group with empty ones. All columns stay; empty: empty.
    """
    rows = cut(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "rows")  # written, so that every scan sees the same keys
    groups = simhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text"))).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    groups = cut(groups.join(rows.select("_row", F.col("_doc.doc_id").alias("doc_id")), "_row"), "groups")
    first = groups.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).getField("_row").alias("_first"))
    gone = groups.select("_row").join(first.select(F.col("_first").alias("_row")), "_row", "left_anti")  # by row, as a group may be large
    return rows.join(gone, "_row", "left_anti").select("_doc.*")


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; ``n_chars`` follows. Null texts and all columns stay; empty: empty."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates fitted to the target tokens say, each at least once.

    Null and empty texts have no tokens and the prior's rate; without labels all rates are 1. All columns stay; empty: empty.
    """
    return mixing.resample(docs, table(spark, sf_dir, "labels"), LIFTS, least=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests, a row a document; null text is the end id alone. Other columns go; empty: empty."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", good_quality), ("near duplicates", one_of_each), ("secrets", no_secrets), ("mixing", mixed), ("tokens", tokens)]

#: the quality model, fingerprints and tokens aren't expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what the one before wrote is deleted. Empty tables: no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        was, docs = docs, cut(stage(spark, docs, sf_dir), "stage")
        drop_cut(was)
    return docs
