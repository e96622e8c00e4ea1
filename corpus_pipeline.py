"""A training corpus from ``documents``: identify languages, drop repeated lines and near copies, mix, encode.

``STAGES`` lists the steps; each takes (spark, docs, sf_dir) and returns the documents that go on, whole, with the
columns of ``documents``; the last returns the encoded documents. ``run`` chains them, each stored as Parquet in the
session's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import language, lines, mixing, near, pieces, queries
from sightline.llm.common import WORD, stored, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1 (operator 4): documents whose language is recognised; the identifier is learned from these documents."""
    identifier = language.train(docs)
    found = language.identify(docs, identifier, out="__language")
    return found.where(~F.col("__language.rejected")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2 (operator 9): texts without repeated lines, n_chars anew; a document that loses all its words goes."""
    found = lines.dedup_lines(docs, info="__lines")
    left = (F.col("__lines.n_dropped") == 0) | F.col("text").rlike(WORD)
    size = F.when(F.col("__lines.n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(left).withColumn("n_chars", size).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3 (operator 3): one document of each group of near copies."""
    return near.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4 (operator 1): documents drawn so that tokens meet the target marginals."""
    return queries.mixed(docs).where("mix_kept").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5 (operator 5): ids of every document, with digests of the ids and of what they decode to."""
    found = pieces.token_digests(docs.select("doc_id", "text"), queries.model_path())
    return found.select("doc_id", "tokens.n_tokens", "tokens.ids_sha256", "tokens.decoded_sha256")


STAGES = [
    ("language", keep_languages),
    ("lines", drop_lines),
    ("near", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: The stages learn models and encode by backtracking, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
