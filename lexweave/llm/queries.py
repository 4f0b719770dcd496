"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, exact_dedup, language, packing, pii, quality, resampling, sharding, simhash, suffix_dedup, toxicity, urls
from .common import crc_fold, shared_dir
from .oracles import ORACLES  # noqa: F401


#: The rules of the url query.
URL_RULES = [urls.Rule.parse(x) for x in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = crc_fold("doc_id", 4) == 2
    found = language.identify(docs, language.learn(docs.where(~held)))
    return found.withColumn("held_out", held)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest_of(decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_of(pii.find(_read(spark, sf_dir, "documents")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents"), 8, map_folder=f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).drop("vslot")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = crc_fold("doc_id", 5) == 0
    machine = quality.learn(docs, _read(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, machine).withColumn("held_out", held)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = crc_fold("doc_id", 3) == 1
    machine = toxicity.learn(docs, _read(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, machine).withColumn("held_out", held)


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(*clustering.cluster(_read(spark, sf_dir, "embeddings")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language": op2_language,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
    "op11_toxicity": op11_toxicity,
    "op12_clustering": op12_clustering,
    "op13_resampling": op13_resampling,
}
