"""A training corpus from `documents`: five stages, each reading what the last one wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import mixing, near_dedup, packing, secret_scan, toxicity
from varve.llm.common import ship, written
from varve.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The classifier learns from the labelled rows of `docs`."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scored(docs, model) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one text of the document with the smallest id stays.

    Documents without words, and rows without an id, are no duplicates and
    stay. Texts that share an id are judged one by one; of rows equal in id
    and text one stays.
    """
    found = near_dedup.groups(docs)
    alone = found.where("doc_id IS NULL OR n_shingles = 0").groupBy("doc_id", "md5").agg(F.lit(1).cast("long").alias("rows"))
    first = found.where("n_shingles > 0 AND doc_id = component_id").groupBy("family", "doc_id", "k1", "k2", "md5").agg(F.count("*").alias("rows"))
    one = first.groupBy("family").agg(F.min(F.struct("k1", "k2", "md5", "doc_id", "rows")).alias("one")).select("one.doc_id", "one.md5", "one.rows")
    stay = written(one.unionByName(alone), "stay").select(F.col("doc_id").alias("_id"), F.col("md5").alias("_md5"), F.col("rows").alias("_rows"))
    md5 = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    # a null id isn't a key that all its rows would meet under
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    same = (key == F.coalesce(F.col("_id").cast("string"), F.lit("-"))) & (md5 == F.col("_md5"))
    once = docs.join(stay.where("_rows = 1"), same, "left_semi")
    repeated = docs.join(stay.where("_rows > 1"), same, "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = repeated.groupBy("doc_id", md5.alias("_md5")).agg(F.min(F.struct(*columns)).alias("_one")).select("_one.*")
    return once.unionByName(least)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced and n_chars follows."""
    clean = secret_scan.redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: documents are left out or repeated."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier and the packing can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
