"""The registered queries of this subpackage; each reads a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import hard_negatives, media, mixing, vantage, warc
from varve.llm.fingerprints import fingerprinted, linked
from varve.llm.kneser_ney import held_out_scores
from varve.llm.near_dedup import near_duplicates
from varve.llm.packing import packed
from varve.llm.secret_scan import secrets
from varve.llm.sharding import placed
from varve.llm.toxicity import toxicity
from varve.llm.whitening import whitened
from varve.session import table


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(media.stored(table(spark, sf_dir, "documents")))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(table(spark, sf_dir, "documents"))


def op6_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates by the bands of MinHash signatures, joined in Spark and verified by Jaccard."""
    return linked(table(spark, sf_dir, "documents"))


def op7_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 64 shards, by id."""
    return placed(table(spark, sf_dir, "documents"), "doc_id", [f"shard-{i:03d}" for i in range(64)])


def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_blockmatrix_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op12_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.integer_rows(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return hard_negatives.mined(rows, rows.where("vec_id % 100 = 0"))


def op13_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vantage.searchable(table(spark, sf_dir, "embeddings"))
    return vantage.nearest(rows, rows.where("vec_id % 20 = 0"))


QUERIES = {
    "op1_progressive_jpeg": op1_progressive_jpeg,
    "op2_superminhash": op2_superminhash,
    "op3_warc_normaliser": op3_warc_normaliser,
    "op4_secret_scan": op4_secret_scan,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_minhash_fingerprints": op6_minhash_fingerprints,
    "minhash_groups": minhash_groups,
    "op7_lookup_sharding": op7_lookup_sharding,
    "op8_swap_packing": op8_swap_packing,
    "op9_source_mixing": op9_source_mixing,
    "op10_compression_toxicity": op10_compression_toxicity,
    "op11_blockmatrix_whitening": op11_blockmatrix_whitening,
    "op12_threshold_negatives": op12_threshold_negatives,
    "op13_vantage_trees": op13_vantage_trees,
}

#: DuckDB SQL where SQL can express the whole result.
ORACLES: dict[str, str] = {
    "op3_warc_normaliser": warc.SQL,
    "op9_source_mixing": mixing.SQL,
    "op12_threshold_negatives": hard_negatives.SQL,
}
