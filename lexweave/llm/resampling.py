"""Importance resampling towards a target: documents are drawn in proportion to how much likelier their
hashed n-grams are in the target than in the corpus.

Each task runs SQL in an embedded DuckDB over its own rows, a few megabytes of text at a time: words are
unnested, a window joins neighbours to n-grams, and a registered function hashes these by zlib's CRC-32. A
task's own bucket counts, and those of each document, are spilled to Parquet in the shared folder; Spark
merges the tasks' counts, scores documents from theirs, and ranks the draws. Drawing is by Gumbel noise that
depends on the document's id alone, so the highest scores are a sample without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.counts import ranked
from .common import forget, written

#: A word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that one statement works on; a longer text goes in parts.
PART = 1 << 20
_SPILL = "row long, doc_id long, n_words long, n_features long, found binary, buckets array<int>, counts array<long>"
_INSIDE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _crc32(grams: pa.Array) -> pa.Array:
    """CRC-32 of each string of each list."""
    if isinstance(grams, pa.ChunkedArray):
        grams = grams.combine_chunks()
    flat = grams.flatten().cast(pa.binary())
    codes = np.fromiter(map(zlib.crc32, flat.to_numpy(zero_copy_only=False)), np.int64, len(flat))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(grams).to_numpy(zero_copy_only=False))]).astype(np.int32)), pa.array(codes))


def statement(longest: int, buckets: int) -> str:
    """Bucket counts of each row of part(row, shared, text): runs of 1 to `longest` words. `shared` words at
    the beginning were counted in the part before; runs that end among them don't count again."""
    after = ", ".join(f"lead(w, {k}) OVER (PARTITION BY row ORDER BY i) AS w{k}" for k in range(1, longest))
    runs = ", ".join(f"CASE WHEN i + {k} > shared THEN {' || chr(32) || '.join(['w', *(f'w{j}' for j in range(1, k))])} END" for k in range(1, longest + 1))
    return f"""
        WITH words AS (SELECT row, shared, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT row, shared, regexp_extract_all(text, '{WORD}') AS ws FROM part)),
        beside AS (SELECT *{", " + after if after else ""} FROM words),
        grams AS (SELECT row, unnest([{runs}]) AS gram FROM beside),
        hashed AS (SELECT row, unnest(zlib_crc32(list(gram))) AS h FROM grams WHERE gram IS NOT NULL GROUP BY row)
        SELECT row, (h % {buckets})::INTEGER AS bucket, count(*) AS n FROM hashed GROUP BY 1, 2 ORDER BY 1, 2"""


def connection(memory: str = "300MB") -> duckdb.DuckDBPyConnection:
    """In memory, one thread, nothing on local disks."""
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
    con.create_function("zlib_crc32", _crc32, ["VARCHAR[]"], "BIGINT[]", type="arrow")
    return con


def _cut(text: bytes, longest: int) -> Iterator[tuple[int, bytes]]:
    """(shared, part) of a long text, cut between words; each part begins with the last longest - 1 words of
    the one before. A word longer than a part stays whole."""
    inside = _INSIDE[np.frombuffer(text, np.uint8)]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    lo, shared = 0, 0
    while True:
        # the cut is where the first word past PART bytes begins
        k = max(int(np.searchsorted(begins, lo + PART)), int(np.searchsorted(begins, lo)) + shared + 1)
        if k >= len(begins):
            yield shared, text[lo:]
            return
        yield shared, text[lo : int(begins[k])]
        shared = min(longest - 1, k)
        lo = int(begins[k - shared])


def _groups(texts: list[bytes], rows: list[int]) -> Iterator[list[int]]:
    """Rows whose texts have about PART bytes together; a longer text is a group of its own."""
    held, size = [], 0
    for row in rows:
        if held and size + len(texts[row]) > PART:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(texts[row])
    if held:
        yield held


def _counted(con: duckdb.DuckDBPyConnection, sql: str, rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, n), sorted, of rows (row, shared, text)."""
    row, shared, text = zip(*rows, strict=True)
    con.register("part", pa.table({"row": pa.array(row, pa.int64()), "shared": pa.array(shared, pa.int64()), "text": pc.ascii_lower(pa.array(text, pa.binary()).cast(pa.string()))}))
    found = con.sql(sql).to_arrow_table()
    con.unregister("part")
    return found["row"].to_numpy(), found["bucket"].to_numpy(), found["n"].to_numpy()


def packed(bucket: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending buckets as steps, which are small, then their counts."""
    return np.diff(bucket, prepend=0).astype("<u2").tobytes() + n.astype("<u4").tobytes()


def unpacked(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = len(found) // 6
    return np.cumsum(np.frombuffer(found, "<u2", size).astype(np.int64)), np.frombuffer(found, "<u4", size, 2 * size).astype(np.int64)


def bucket_counts(con: duckdb.DuckDBPyConnection, texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """How many n-grams each text has, how many fall in each bucket (packed), and the sums over all texts.
    Equal texts are worked on once."""
    first: dict[bytes, int] = {}
    same = [first.setdefault(t, k) for k, t in enumerate(texts)]
    copies = np.bincount(same, minlength=len(texts)) if texts else np.zeros(0, np.int64)
    features, found, total = np.zeros(len(texts), np.int64), [b""] * len(texts), np.zeros(buckets, np.int64)
    sql = statement(longest, buckets)
    for group in _groups(texts, sorted(first.values())):
        if len(group) == 1 and len(texts[group[0]]) > PART:  # its parts meet in one array of all buckets
            sums = np.zeros(buckets, np.int64)
            for shared, part in _cut(texts[group[0]], longest):
                _, bucket, n = _counted(con, sql, [(0, shared, part)])
                np.add.at(sums, bucket, n)
            bucket = np.flatnonzero(sums)
            row, n = np.full(len(bucket), group[0]), sums[bucket]
        else:
            row, bucket, n = _counted(con, sql, [(k, 0, texts[k]) for k in group])
        np.add.at(total, bucket, n * copies[row])
        at = np.searchsorted(row, [*group, group[-1] + 1])
        for k, a, b in zip(group, at, at[1:], strict=False):
            features[k], found[k] = n[a:b].sum(), packed(bucket[a:b], n[a:b])
    return features[same] if texts else features, [found[k] for k in same], total


def spilled(docs: DataFrame, *, longest: int, buckets: int, text: str, doc_id: str | None, each: bool) -> DataFrame:
    """A written table: a row for each document with its bucket counts (if `each`), and a row for each task
    with the sums of its buckets."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, total = connection(), np.zeros(buckets, np.int64)
        for batch in batches:
            features, found, sums = bucket_counts(con, [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()], longest, buckets)
            total += sums
            if each:
                none = pa.nulls(len(found))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words_in(features, longest)), pa.array(features), pa.array(found, pa.binary()), none.cast(pa.list_(pa.int32())), none.cast(pa.list_(pa.int64()))], _NAMES)
        hit = np.flatnonzero(total)
        null = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([null, null, null, null, pa.nulls(1, pa.binary()), pa.array([hit.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[hit]], pa.list_(pa.int64()))], _NAMES)

    ident = F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")
    return written(docs.select(F.monotonically_increasing_id().alias("row"), ident.alias("doc_id"), F.col(text).alias("text")).mapInArrow(mapped, _SPILL))


_NAMES = ["row", "doc_id", "n_words", "n_features", "found", "buckets", "counts"]


def words_in(features: np.ndarray, longest: int) -> np.ndarray:
    """How many words have so many runs of 1 to `longest` words: of w words w + (w - 1) + ..."""
    few = np.arange(longest + 1) * (np.arange(longest + 1) + 1) // 2
    many = (features + longest * (longest - 1) // 2) // longest
    return np.where(features >= few[-1], many, np.searchsorted(few, features))


def merged(spill: DataFrame) -> DataFrame:
    """(bucket, n) over all tasks: as many rows as there are buckets."""
    pairs = spill.where("counts is not null").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(F.broadcast(source.withColumnRenamed("n", "s")), "bucket", "left").join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left").na.fill(0)
    total = both.agg(F.sum("s"), F.sum("t")).first()
    plus = lambda c, k: F.col(c).cast("double") + float(k)
    ratio = plus("t", 1) * float(total[0] + buckets) / (plus("s", 1) * float(total[1] + buckets))
    rows = both.select("bucket", F.floor(F.log(ratio) * float(scale)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weighed(spill: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight): the floored mean gain of each document's features."""
    shared = spill.sparkSession.sparkContext.broadcast(gain)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            sums = []
            for found in batch.column(4).to_pylist():
                bucket, times = unpacked(found)
                sums.append(int(gain[bucket] @ times))
            n = np.asarray(batch.column(3))
            weight = np.array(sums, np.int64) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight)], [*_NAMES[:4], "weight"])

    rows = spill.where("found is not null").select("row", "doc_id", "n_words", "n_features", "found")
    return rows.mapInArrow(mapped, "row long, doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, salt: str, scale: int = 1000) -> Column:
    """floor(-scale * ln(-ln(u))) of u in (0, 1) from the hash of salt and id; a null id is hashed as ''."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * float(-scale))


@dataclass(frozen=True)
class Draw:
    """Parameters of a draw; `buckets` is at most 65,536."""

    longest: int = 2
    buckets: int = 10_000
    share: int = 25  # per cent of the documents with at least `least_words` words
    least_words: int = 20
    salt: str = "7:"


def resample(docs: DataFrame, target: DataFrame, draw: Draw | None = None, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it isn't drawn.

    target: any table with the same text column. A null or empty text has no words, weight 0, and is never
    drawn. Rows that repeat a doc_id are documents of their own with the same noise; of equal scores and ids
    the earlier row comes first, and a null doc_id comes after all others. An empty table gives no rows; with
    an empty target all gains follow the corpus alone. Other columns, whatever their names, are ignored.
    """
    draw = draw or Draw()
    if not 0 < draw.buckets <= 1 << 16:
        raise ValueError("buckets must be between 1 and 65536")
    how = {"longest": draw.longest, "buckets": draw.buckets, "text": text}
    spill, aim = spilled(docs, doc_id=doc_id, each=True, **how), spilled(target, doc_id=None, each=False, **how)
    gain = gains(merged(spill), merged(aim), draw.buckets)
    scored = written(weighed(spill, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), draw.salt)))
    forget(spill, aim)
    whole = F.col("n_words") >= draw.least_words
    most = scored.where(whole).count() * draw.share // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    drawn = ranked(scored.where(whole), order).withColumn("rank", F.when(F.col("place") <= most, F.col("place"))).drop("place")
    rest = scored.where(~whole).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
