"""Learned models over streams: segmentation is row by row, so no state or watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import Bpe, SentenceBpe, Unigram, WordPiece

Model = Bpe | WordPiece | SentenceBpe | Unigram


def tokenized(stream: DataFrame, model: Model, column: str) -> DataFrame:
    """The rows of a stream with `tokens` beside them."""
    return model.segmented(stream, column)


def running_frequencies(stream: DataFrame, model: Model, column: str) -> DataFrame:
    """(token, c) so far, for complete or update mode; the state is one row a token."""
    rows = tokenized(stream.where(F.col(column) != ""), model, column)
    return rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, written once, then stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
