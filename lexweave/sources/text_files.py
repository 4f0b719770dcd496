"""Word lists and sentence files, and the same rules over a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, place) of text files split at line feeds only, read in splits; invalid UTF-8 is an error.

    place orders the lines as they stand in their files: by file, split and row."""
    rows = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.validate_utf8("value").alias("value"), place.alias("place"))


def useful(rows: DataFrame, value: str = "value") -> DataFrame:
    """Trimmed lines; empty ones and comments (#) go."""
    return rows.withColumn(value, trimmed(value)).where((F.col(value) != "") & ~F.startswith(F.col(value), F.lit("#")))


def first_field(value: str = "value"):
    return F.split(F.col(value), r"(?U)\s+")[0]


def limited(rows: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first rows in order, all without a limit."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def first_lines(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of files in their order, all without a limit. rows: with place, as lines() gives it.

    Rows are counted by split; whole splits are taken as they are until the limit falls into one, and only
    that one is ordered and cut. At most one count a split reaches the driver."""
    if limit is None:
        return rows
    found = rows.groupBy(F.col("place.path").alias("path"), F.col("place.split").alias("split")).agg(F.count(F.lit(1)).alias("n")).collect()
    whole, cut, left = [], None, limit
    for r in sorted(found, key=lambda r: (r["path"], r["split"])):
        if r["n"] > left:
            cut = (r["path"], r["split"])
            break
        whole.append((r["path"], r["split"]))
        left -= r["n"]
    taken = rows.sparkSession.createDataFrame(whole, "__path string, __split long")
    of = (F.col("place.path") == F.col("__path")) & (F.col("place.split") == F.col("__split"))
    out = rows.join(F.broadcast(taken), of, "left_semi")
    if cut is None or not left:
        return out
    last = rows.where((F.col("place.path") == cut[0]) & (F.col("place.split") == cut[1]))
    return out.unionByName(last.orderBy("place").limit(left))


def load_words(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(word, place): the first field of each useful line; with a limit the first so many in file order."""
    return _required(first_lines(useful(lines(spark, path)), limit).select(first_field().alias("word"), "place"), path)


def load_sentences(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(sentence, place): each useful line, whole."""
    return _required(first_lines(useful(lines(spark, path)), limit).select(F.col("value").alias("sentence"), "place"), path)


def _required(rows: DataFrame, path: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"no usable lines in {path}")
    return rows


#: Tables under this many bytes a core are dealt to all cores before their texts are cut up.
SMALL_SPLIT = 16 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table in few splits (one row group, say) over all cores; any other as it is."""
    if table.isStreaming:
        return table
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # an estimate; only the splits depend on it
    return table.repartition(cores) if size < cores * SMALL_SPLIT else table


def words_of(table: DataFrame, text: str = "text") -> DataFrame:
    """word: everything between white space in a text column."""
    return spread(table.select(F.col(text).alias("text"))).select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''")


def sentences_of(table: DataFrame, text: str = "text") -> DataFrame:
    """sentence: the useful lines of a text column."""
    return useful(spread(table.select(F.col(text).alias("text"))).select(F.explode(F.split("text", "\n")).alias("value"))).select(F.col("value").alias("sentence"))


def histogram(rows: DataFrame, column: str, place: str | None = None) -> DataFrame:
    """(column, n): every count that follows is linear in how often a row repeats. With a column that orders
    the rows, `first` is where each stands first."""
    first = [F.min(place).alias("first")] if place else []
    return rows.where(F.col(column) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n"), *first)
