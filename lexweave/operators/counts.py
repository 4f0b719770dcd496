"""Counting operators: pairs, tokens, characters, substrings, coverage, top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import CONTINUES, adjacent
from ..plans.tables import forget, written
from .lattice import Trie
from .points import parts, points, summed


def pair_counts(segments: DataFrame) -> DataFrame:
    """(l, r, c) over segments (tokens, n): every adjacent place counts, n times."""
    flat = segments.select(F.explode(adjacent(F.col("tokens"))).alias("p"), "n")
    return flat.groupBy("p.l", "p.r").agg(F.sum("n").alias("c"))


def token_counts(segments: DataFrame) -> DataFrame:
    """(token, c) over segments (tokens, n)."""
    return segments.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("c"))


def top_pairs(pairs: DataFrame, k: int, least: int = 1) -> DataFrame:
    """Most frequent first, then left, then right, by bytes."""
    return pairs.where(F.col("c") >= least).orderBy(F.desc("c"), "l", "r").limit(k)


def character_counts(texts: DataFrame, column: str) -> DataFrame:
    """(ch, c) over (column, n). Tasks sum the code points of whole batches; a row a task and character is
    shuffled."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros(0)
        for table in parts(batches):
            codes, sizes = points(table["s"])
            found = np.bincount(codes, np.repeat(table["n"].to_numpy(), sizes), len(every)).astype(np.float64)
            found[: len(every)] += every
            every = found
        seen = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in seen.tolist()], pa.string()), pa.array(every[seen].astype(np.int64))], ["ch", "c"])

    rows = texts.select(F.col(column).alias("s"), F.col("n").cast("long").alias("n"))
    return rows.mapInArrow(mapped, "ch string, c long").groupBy("ch").agg(F.sum("c").alias("c"))


def coverage_cut(chars: DataFrame, coverage: float) -> DataFrame:
    """The characters kept: while those before them cover less than trunc(total * coverage).

    The window has one partition, over an alphabet: at most 1.1 million code points exist."""
    before = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("c"), "ch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = chars.withColumns({"before": before, "total": F.sum("c").over(Window.partitionBy())})
    return ranked.where(F.col("before") < F.floor(F.col("total") * F.lit(float(coverage)))).select("ch", "c")


#: Code points of the sample that likely substrings come from, and rows that repeat most often beside it.
SAMPLE_POINTS, HEAVY = 1_000_000, 200
#: Numbers of a task's table of sums; beyond that sums are made block by block.
DENSE = 1 << 22


def _likely(texts: list[str], weights: list[float], k: int, longest: int) -> list[str]:
    """About the k most frequent substrings of 2 to `longest` code points of few texts: all of one length are
    counted at once, and only those go on that may be among the best."""
    codes, sizes = points(pa.array(texts, pa.string()))
    if not len(codes):
        return []
    letters = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width, end, weight = int(letters.max()) + 1, np.repeat(np.cumsum(sizes), sizes), np.repeat(np.asarray(weights, np.float64), sizes)
    at, node, bar = np.arange(len(codes)), letters, 0.0
    starts, lengths, sums = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for length in range(2, longest + 1):
        inside = at + length <= end[at]
        at, node = at[inside], node[inside]
        if not len(at):
            break
        _, lead, node = np.unique(node * width + letters[at + length - 1], return_index=True, return_inverse=True)
        c = np.bincount(node, weight[at])
        starts, lengths, sums = np.concatenate([starts, at[lead]]), np.concatenate([lengths, np.full(len(lead), length)]), np.concatenate([sums, c])
        if len(sums) > k:
            bar = np.partition(sums, len(sums) - k)[len(sums) - k]
        keep = sums >= bar
        starts, lengths, sums = starts[keep], lengths[keep], sums[keep]
        on = c[node] >= bar
        at, node = at[on], node[on]
    best = np.argsort(-sums, kind="stable")[:k]
    return [codes[a : a + n].tobytes().decode("utf-32-le") for a, n in zip(starts[best].tolist(), lengths[best].tolist(), strict=True)]


def _continued(nodes: list[str], longest: int):
    """(code, c): how often each node is followed by each letter, inside texts (s, n). A code is the node's
    number times the letters (and none), plus the letter."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(nodes)
        width = int(trie.letter.max()) + 1
        dense = len(nodes) * width <= DENSE
        every = np.zeros(len(nodes) * width if dense else 0)
        for table in parts(batches):
            codes, sizes = points(table["s"])
            place = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
            letters, weight = np.zeros(len(codes) + len(sizes), np.int32), np.zeros(len(codes) + len(sizes))
            letters[place] = trie.letter[np.minimum(codes, len(trie.letter) - 1)]
            weight[place] = np.repeat(table["n"].to_numpy(), sizes)
            at = np.flatnonzero(letters)
            node = trie.base[0] + letters[at]
            ok = trie.check[node] == 0
            at, node = at[ok], node[ok]
            for length in range(1, longest):
                following = letters[at + length]
                some = following > 0
                at, node, following = at[some], node[some], following[some]
                if not len(at):
                    break
                code = trie.piece[node].astype(np.int64) * width + following
                if dense:
                    found = np.bincount(code, weight[at])
                    every[: len(found)] += found
                else:
                    code, c = summed(code, weight[at])
                    yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(c, pa.int64())], ["code", "c"])
                slot = trie.base[node] + following
                ok = trie.check[slot] == node
                at, node = at[ok], slot[ok]
        code = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(every[code].astype(np.int64))], ["code", "c"])

    return mapped


def top_substrings(texts: DataFrame, column: str, k: int, longest: int = 16) -> list[tuple[str, int]]:
    """The k most frequent substrings of 2 to `longest` code points, over (column, n); ties in byte order.

    A pass counts, exactly and in all texts, what follows each node of a trie: all characters, and what a
    bounded sample says is frequent. If all of the k best found are nodes themselves (or as long as may be),
    they are the k best of all: what wasn't counted goes on from something counted that is no node, which
    isn't better than the k best, and what goes on from it is no more frequent and comes later by bytes. Else
    those that aren't nodes become nodes, and a pass is made again; a bad sample costs passes, never results.
    The shuffle holds sums, no places."""
    if k <= 0 or longest < 2:
        return []
    spark = texts.sparkSession
    rows = texts.select(F.col(column).alias("s"), F.col("n").cast("long").alias("n")).where("s <> ''")
    table = None if hasattr(texts, "written_to") else written(rows)  # read several times
    rows = rows if table is None else table
    letters = sorted(r["ch"] for r in character_counts(rows, "s").select("ch").collect())  # an alphabet
    size = rows.agg(F.sum(F.length("s").cast("long"))).first()[0] or 0
    share = min(1.0, SAMPLE_POINTS / max(1, size))
    cut = F.substring("s", 1, 10_000).alias("s")
    sample = [(r["s"], r["n"] / share) for r in rows.where(F.shiftrightunsigned(F.xxhash64("s"), 2) <= int(share * (2**62 - 1))).select(cut, "n").collect()]
    if share < 1:
        sample += [(r["s"], float(r["n"])) for r in rows.orderBy(F.desc("n")).select(cut, "n").limit(HEAVY).collect()]
    nodes = {t[:n] for t in _likely([s for s, _ in sample], [n for _, n in sample], 2 * k, longest - 1) for n in range(2, len(t) + 1)} | {*letters}
    width = len(letters) + 1
    tails = F.broadcast(spark.createDataFrame(list(enumerate(letters, 1)), "letter long, tail string"))
    while True:
        heads = F.broadcast(spark.createDataFrame(list(enumerate(sorted(nodes))), "node long, head string"))
        found = rows.mapInArrow(_continued(sorted(nodes), longest), "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
        found = found.select("c", F.expr(f"code div {width}").alias("node"), F.expr(f"code % {width}").alias("letter"))
        named = found.join(heads, "node").join(tails, "letter").select(F.concat("head", "tail").alias("token"), "c")
        best = [(r["token"], r["c"]) for r in named.orderBy(F.desc("c"), "token").limit(k).collect()]
        lacking = {t for t, _ in best if len(t) < longest} - nodes
        if not lacking:
            forget(table)
            return best
        nodes |= lacking


def corpus_stats(rows: DataFrame, column: str) -> DataFrame:
    """n_rows, n_chars, mean_chars over (column, n)."""
    return rows.agg(F.sum("n").alias("n_rows"), F.sum(F.length(column).cast("long") * F.col("n")).alias("n_chars")).withColumn("mean_chars", F.round(F.col("n_chars") / F.col("n_rows"), 6))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows, and `place` 1, 2, 3 ... in the order of columns that tell all rows apart: sorted by ranges and
    written, then numbered by how many rows the ranges before hold. No task sees all rows."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    table = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    block = F.shiftrightunsigned("__at", 33)
    ahead, offsets = 0, []
    for r in table.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect():  # a row a partition
        offsets.append((r["block"], ahead))
        ahead += r["n"]
    starts = spark.createDataFrame(offsets, "__block long, __ahead long")
    numbered = table.withColumn("__block", block).join(F.broadcast(starts), "__block")
    return numbered.withColumn("place", F.col("__ahead") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__block", "__ahead")


def first_characters(texts: DataFrame, column: str, at: list[str], words: bool = False, pieces: bool = False) -> DataFrame:
    """(token, row_no, pos) of the characters of texts: for each at least where it stands first, by the columns
    `at`, in order, and its place in the text; a few rows a block instead of one a place. With `words`, white
    space parts words, which are numbered as split() does: row_no ends in the word, pos is the place there.
    With `pieces`, a character that isn't the first one is a token of its own, with the continuation prefix."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in parts(batches):
            keys = table.select([f"k{i}" for i in range(len(at))])
            order = pc.sort_indices(keys, [(c, "ascending") for c in keys.column_names], null_placement="at_start").to_numpy()
            # rows with one key compare by their places: they go apart
            ordered = keys.take(pa.array(order))
            same = np.ones(max(0, len(order) - 1), bool)
            for c in ordered.columns:
                x = c.combine_chunks()
                equal = pc.equal(x[1:], x[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
                same &= equal | (pc.is_null(x[1:]).to_numpy(zero_copy_only=False) & pc.is_null(x[:-1]).to_numpy(zero_copy_only=False))
            lead = np.concatenate([[True], ~same])
            layer = np.arange(len(order)) - np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
            for depth in range(int(layer.max()) + 1):
                yield first(table.take(pa.array(order[layer == depth])))

    def first(table: pa.Table) -> pa.RecordBatch:
        codes, sizes = points(table["s"])
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(codes)) - np.repeat(begin, sizes)
        kind = np.where(place > 0, codes.astype(np.int64) + LATER, codes) if pieces else codes.astype(np.int64)
        inside = ~np.isin(codes, SPACES) if words else np.ones(len(codes), bool)
        at_first = np.full(int(kind.max()) + 1 if len(kind) else 0, -1, np.int64)
        use = np.flatnonzero(inside)[::-1]
        at_first[kind[use]] = use  # the last to be written stands first
        seen = np.flatnonzero(at_first >= 0)
        found = at_first[seen]
        row = np.searchsorted(begin, found, "right") - 1 if len(sizes) else found
        pos = place[found]
        out = [pa.array([chr(c) if c < LATER else CONTINUES + chr(c - LATER) for c in seen.tolist()], pa.string())]
        numbers = [table[f"k{i}"].take(pa.array(row)).combine_chunks() for i in range(len(at))]
        if words:
            space = np.concatenate([~inside, [False]])
            fresh = np.zeros(len(codes) + 1, bool)
            fresh[begin[sizes > 0]] = True
            runs = np.cumsum(space & (fresh | ~np.concatenate([[False], space[:-1]])))
            ahead = np.where(begin > 0, runs[np.maximum(begin - 1, 0)], 0)
            last = np.maximum.accumulate(np.where(fresh | np.concatenate([[False], space[:-1]]), np.arange(len(codes) + 1), 0))
            pos = found - last[found]
            numbers.append(pa.array((runs[found] - ahead[row]).astype(np.int32)))
        return pa.RecordBatch.from_arrays([*out, *numbers, pa.array(pos.astype(np.int32))], names)

    rows = texts.select(F.col(column).alias("s"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(at)])
    fields = [StructField(f"k{i}", rows.schema[f"k{i}"].dataType) for i in range(len(at))] + ([StructField("w", IntegerType())] if words else [])
    names = ["token", *(f.name for f in fields), "pos"]
    found = rows.mapInArrow(mapped, StructType([StructField("token", StringType()), *fields, StructField("pos", IntegerType())]))
    return found.select("token", F.struct(*[f.name for f in fields]).alias("row_no"), "pos")


#: White space that parts words, and what is added to the code point of a character that isn't a word's first.
SPACES, LATER = np.array([9, 10, 11, 12, 13, 32], np.uint32), 1 << 21


def first_seen_ids(tokens: DataFrame) -> DataFrame:
    """(token_id, token) numbered by first occurrence; tokens: (token, row_no, pos). Dense ranks of distinct
    tokens, however many, by ranges of where they stand first."""
    first = tokens.groupBy("token").agg(F.min(F.struct("row_no", "pos")).alias("at"))
    return ranked(first, [F.col("at")]).select((F.col("place") - 1).alias("token_id"), "token")
