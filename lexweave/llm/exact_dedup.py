"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]. Each
map task first combines its own copies (the partial aggregate, keyed by digest *and* full content),
salted groups then merge what the tasks found, and the salts' winners are combined globally. All
three stages compare the full content, so two texts that share a digest never become one group. No
stage sees more than one row a task for each text, however hot it is. Documents find their group
through the digest, hot groups by broadcast; should two different texts ever share a digest, a join on
the full content does it.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, numbered, text_or_empty, written

_ID_SPAN = Decimal(10**20)
_ID_TOP = Decimal(2**63 - 1)


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def sha256_of(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _groups(rows: DataFrame, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, content, rank, first, group_size) of each text: local, salted and global combining, by the
    full content each time. rows: (doc_id, row, content, points)."""
    rank = F.col("points").cast("decimal(15,0)") * F.lit(_ID_SPAN) + F.coalesce(F.lit(_ID_TOP) - F.col("doc_id").cast("decimal(19,0)"), F.lit(Decimal(-1)))
    keyed = rows.select(digest(F.col("content")).alias("digest"), "content", "row", rank.cast("decimal(38,0)").alias("rank"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = keyed.groupBy("digest", "content", "salt").agg(F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(F.max_by("row", "rank").alias("first"), F.max("rank").alias("rank"), F.sum("n").alias("group_size"))


def _joined(rows: DataFrame, groups: DataFrame, whole: DataFrame, digest: Callable[[Column], Column], names: list[str]) -> DataFrame:
    """rows with `names` and group_size of their group; null where they are alone, as only groups of several
    rows are joined. Should different texts share a digest, the full content is compared."""
    shared = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    keyed = rows.withColumn("digest", digest(F.col("content")))
    if shared.isEmpty():
        several = groups.where("group_size > 1").select("digest", *names, "group_size", F.col("group_size").alias("n"))
        return hot_join(keyed.drop("content"), written(several), "digest", keyed.columns[0])
    return keyed.join(whole.where("group_size > 1").select("digest", "content", *names, "group_size"), ["digest", "content"], "left")


def exact_dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", salts: int = 16, digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the one with
    the smallest doc_id. A null text counts as empty, so all blank texts are one group. A null
    doc_id loses every tie and never stays beside another id of equal length; rows that repeat the
    winner's doc_id all count as kept. An empty table gives no rows. Other columns are ignored.
    `digest` maps content to the binary key that groups are dealt by.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("raw"))
    rows = rows.select("doc_id", normalised(F.col("raw")).alias("content"), F.length("raw").alias("points"))
    left = F.pmod(F.col("rank") + 1, F.lit(_ID_SPAN)) - 1
    best = F.when(left >= 0, F.lit(_ID_TOP) - left).cast("long").alias("keep_id")
    whole = _groups(rows.withColumn("row", F.lit(0)), salts, digest).select("digest", "content", best, "group_size")
    groups = written(whole.drop("content"))
    joined = _joined(rows.select("doc_id", "content", F.sha2("content", 256).alias("text_sha256")), groups, whole, digest, ["keep_id"])
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (single | F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", salts: int = 16, digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """The rows of docs with one row of each text: the one exact_dedup keeps, or one of those that repeat it.
    Rows with a null doc_id are rows like any other. All columns stay."""
    body = F.coalesce(F.col(f"all.`{text}`"), F.lit(""))
    rows = numbered(docs).select("row", F.col(f"all.`{doc_id}`").cast("long").alias("doc_id"), normalised(body).alias("content"), F.length(body).alias("points"), "all")
    whole = _groups(rows, salts, digest)
    groups = written(whole.drop("content", "rank"))
    joined = _joined(rows.select("row", "content", "all"), groups, whole, digest, ["first"])
    return joined.where(F.col("group_size").isNull() | (F.col("row") == F.col("first"))).select("all.*")
