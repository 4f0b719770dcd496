"""What several operators share: written tables, Arrow text buffers, and row-level folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import forget, shared_dir, written  # noqa: F401

#: The characters of [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def numbered(docs: DataFrame) -> DataFrame:
    """(row, all): docs written once with a number for each row and its columns as a struct. A number that is
    computed in each plan that reads a table depends on how that plan splits it; this one doesn't."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")))


def hot_join(left: DataFrame, right: DataFrame, key: str, by: str, size: str = "n", most: int = 1000) -> DataFrame:
    """left join right on `key`, which is unique in right, a written table whose column `size` tells how many
    rows of left have it; `by` is a column of left that tells these apart. Keys with more than a `most`-th of
    all these rows, so fewer than `most` of them, are broadcast; their rows never meet in one task. The rest
    is joined by sorting, whatever its size. `size` itself is dropped."""
    bar = (right.agg(F.sum(size)).first()[0] or 0) // most
    names, others = [c for c in right.columns if c not in (key, size)], [F.col(c) for c in left.columns]
    hot, rest = right.where(F.col(size) > bar), right.where(F.col(size) <= bar)
    found = left.join(F.broadcast(hot.select(key, *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__hot"))), key, "left")
    # a key already found is spread out, and meets nothing more
    part = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(997)) + 1).otherwise(0).alias("__part")
    apart = found.select(*others, *[f"__{c}" for c in names], part)
    joined = apart.join(rest.select(key, *names, F.lit(0).cast("long").alias("__part")).hint("merge"), [key, "__part"], "left")
    return joined.select(*others, *[F.coalesce(f"__{c}", c).alias(c) for c in names])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the len+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each row; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets, along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def beside(docs: DataFrame, doc_id: str, text: str, mapped, fields: str, whole: bool) -> DataFrame:
    """docs through mapInArrow with `fields` beside doc_id, or with `whole` beside the struct `row` of all
    columns. Column 0 of a batch is what stays, column 1 the text."""
    if not whole:
        return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(mapped, f"doc_id long, {fields}")
    others = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest"), F.col(text).alias("text"))
    out = others.mapInArrow(mapped, f"rest {others.schema['rest'].dataType.simpleString()}, text string, {fields}")
    row = F.struct(*[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]).alias("row")
    return out.select(row, *[c for c in out.columns if c not in ("rest", "text")])


def carried(batch: pa.RecordBatch, whole: bool, made: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """The batch that a function of beside() gives."""
    kept, called = ([batch.column(0), batch.column(1)], ["rest", "text"]) if whole else ([batch.column(0)], ["doc_id"])
    return pa.RecordBatch.from_arrays([*kept, *made], [*called, *names])
