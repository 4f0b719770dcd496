"""Models as Parquet tables, and text dumps of rules and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import Bpe, SentenceBpe, Unigram, WordPiece
from ..operators.unigram import Model

_RULES, _VOCAB = "rank int, l string, r string, merged string", "token_id int, token string, log_prob double"
_KINDS = {"bpe": Bpe, "wordpiece": WordPiece, "sentence_bpe": SentenceBpe, "unigram": Unigram}


def rules_table(spark: SparkSession, model) -> DataFrame:
    rules = getattr(model, "rules", [])
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], _RULES)


def vocab_table(spark: SparkSession, model) -> DataFrame:
    if isinstance(model, Unigram):
        rows = [(k, t, float(p)) for k, (t, p) in enumerate(zip(model.model.vocab, model.model.log_probs, strict=True))]
    else:
        rows = [(k, t, None) for k, t in enumerate(getattr(model, "vocab", []))]
    return spark.createDataFrame(rows, _VOCAB)


def save(spark: SparkSession, model, folder: str) -> None:
    """rules and vocab tables, with the kind beside them."""
    kind = next(k for k, c in _KINDS.items() if isinstance(model, c))
    spark.createDataFrame([(kind,)], "kind string").coalesce(1).write.parquet(f"{folder}/kind")
    rules_table(spark, model).coalesce(1).write.parquet(f"{folder}/rules")
    vocab_table(spark, model).coalesce(1).write.parquet(f"{folder}/vocab")


def load(spark: SparkSession, folder: str):
    kind = spark.read.parquet(f"{folder}/kind").first()["kind"]
    rules = [(r["l"], r["r"], r["merged"]) for r in spark.read.parquet(f"{folder}/rules").orderBy("rank").collect()]
    vocab = [(r["token"], r["log_prob"]) for r in spark.read.parquet(f"{folder}/vocab").orderBy("token_id").collect()]
    if kind == "unigram":
        return Unigram(Model([t for t, _ in vocab], [p for _, p in vocab]))
    return Bpe(rules) if kind == "bpe" else _KINDS[kind]([t for t, _ in vocab], rules)


def rule_lines(spark: SparkSession, model) -> DataFrame:
    """left, tab, right; in rule order."""
    return rules_table(spark, model).orderBy("rank").select(F.concat_ws("\t", "l", "r").alias("value"))


def vocab_lines(spark: SparkSession, model) -> DataFrame:
    """One token a line, in id order; for unigram models token, tab, log probability to six places,
    sorted by the whole line."""
    vocab = vocab_table(spark, model)
    if isinstance(model, Unigram):
        return vocab.select(F.format_string("%s\t%.6f", "token", "log_prob").alias("value")).orderBy("value")
    return vocab.orderBy("token_id").select(F.col("token").alias("value"))


def dump(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.text(path)
