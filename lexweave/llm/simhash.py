"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint has one or more words of 64 bits. Tables deal fingerprints to buckets by some of their
bits. Exact tables take, of n bit blocks, all but `distance`: fingerprints within that distance agree on
one such choice fully. n grows with the table, so buckets don't. Wide tables, for distances too large
for that, take random bits, as many tables as bring a pair at the full distance together with a stated
probability.

In a bucket fingerprints are sorted by Gray rank and packed into a tree: each node keeps the bits that
all below it share, as a mask and a pattern. Two nodes whose shared bits already differ in more than
`distance` places, summed over the words, are skipped with all below them, as are leaves that are one
component already. A bucket gives a spanning forest of its links, never all pairs; alternating star
contraction joins the forests over the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_join, numbered, texts_of, written

_LEAF, _FAN, _CHUNK = 32, 8, 4096
#: Rows of buckets held at a time, and how many fingerprints of unlike texts a bucket is meant to hold.
_HELD, _BUCKET = 200_000, 32
#: Odd multipliers that turn a shingle's hash into the further words' hashes.
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Similarity:
    """What links two texts: shingles of `words` words, fingerprints of `lanes` words of 64 bits, at most
    `distance` differing bits. `recall` is the least probability that wide tables bring a pair at the full
    distance together; exact tables (recall None) bring all."""

    words: int = 4
    lanes: int = 1
    distance: int = 4
    recall: float | None = None

    def tables(self, n: int) -> list[np.ndarray]:
        """The bits of each table's key, for n fingerprints."""
        bits, want = 64 * self.lanes, max(8, math.ceil(math.log2(max(1, n) / _BUCKET + 1)))
        if self.recall is None:
            blocks = self.distance + 2
            while (bits * (blocks - self.distance)) // blocks < want and blocks < 2 * self.distance:
                blocks += 1
            edges = [round(bits * k / blocks) for k in range(blocks + 1)]
            parts = [np.arange(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)]
            return [np.concatenate(c) for c in combinations(parts, blocks - self.distance)]
        meet = math.comb(bits - self.distance, want) / math.comb(bits, want)
        rng = np.random.default_rng(1)
        return [np.sort(rng.choice(bits, want, replace=False)) for _ in range(max(1, math.ceil(math.log(1 - self.recall) / math.log1p(-meet))))]


#: The settings of the query: exact at four bits.
NARROW = Similarity()
#: Five-word shingles with a Jaccard similarity of 0.8 have about 15 % of their bits different.
WIDE = Similarity(words=5, lanes=4, distance=40, recall=0.95)


def _mixed(h: np.ndarray, odd: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(odd)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def fingerprint(raw: bytes, words: int = 4, lanes: int = 1) -> bytes:
    """Big-endian words. A bit is set if it is set in over half the XXH64 (seed 42) of the shingles,
    repeats included; further words count bits of the hashes mixed again."""
    import xxhash

    tokens = raw.lower().split()  # both know ASCII only: A-Z, and [\x20\x09-\x0D]
    if not tokens:
        return bytes(8 * lanes)
    line, h = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    counts, n = np.zeros((lanes, 64), np.int64), max(1, len(tokens) - words + 1)
    for lo in range(0, n, 65536):
        hi = min(n, lo + 65536)
        whole = len(tokens) < words
        found = np.array([h(line, 42)] if whole else [h(line[a:b], 42) for a, b in zip(starts[lo:hi], ends[lo + words - 1 : hi + words - 1], strict=True)], np.uint64)
        for k in range(lanes):
            lane = _mixed(found, _LANES[k - 1]) if k else found
            counts[k] += np.unpackbits(lane.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8").astype(">u8").tobytes()


def fingerprints(docs: DataFrame, like: Similarity = NARROW, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint's bytes) of every row; null or blank texts have zero."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                found = [fingerprint(raw, like.words, like.lanes) for raw in texts_of(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(mapped, "doc_id long, fp binary")


def _words_of(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each fingerprint (a row of words, the highest first) in the reflected Gray order."""
    rank = fps.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    odd = np.zeros(len(fps), np.uint64)
    for k in range(1, fps.shape[1]):  # an odd number of bits before turns the order of the rest
        odd ^= np.bitwise_count(fps[:, k - 1]) & np.uint64(1)
        rank[:, k] ^= np.uint64(0) - odd
    return rank


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if np.array_equal(higher, self.up):
                return self.up
            self.up = higher

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            x, y = roots[a], roots[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            for p, q in zip(x[:512].tolist(), y[:512].tolist(), strict=True):
                p, q = self.find(p), self.find(q)
                if p != q:
                    self.up[max(p, q)] = min(p, q)
            a, b = a[512:], b[512:]


class GrayIndex:
    """The tree over one bucket's distinct fingerprints, rows of words."""

    def __init__(self, fps: np.ndarray):
        self.order = np.lexsort(gray_rank(fps).T[::-1])
        self.fps = fps[self.order]
        self.n = len(fps)
        all_of, any_of = self._fold(self.fps, self.fps, _LEAF)
        self.levels = [(~(any_of ^ all_of), all_of)]  # leaves first: mask of shared bits, pattern
        while len(all_of) > 1:
            all_of, any_of = self._fold(all_of, any_of, _FAN)
            self.levels.append((~(any_of ^ all_of), all_of))

    @staticmethod
    def _fold(all_of: np.ndarray, any_of: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(all_of), fan)
        return np.bitwise_and.reduceat(all_of, at), np.bitwise_or.reduceat(any_of, at)

    def _apart(self, a: np.ndarray, b: np.ndarray, forest: _Forest) -> np.ndarray:
        """Which pairs of leaves are not yet one component."""
        roots, at = forest.roots()[self.order], np.arange(0, self.n, _LEAF)
        low, high = np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)
        return (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])

    def links(self, distance: int, forest: _Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in the input at most `distance` bits apart, in chunks; with a forest over the
        places, which the caller keeps up to date, pairs within one component may be left out."""
        if forest is not None:  # neighbours first: what is one component soon needs no comparing
            near = np.flatnonzero(np.bitwise_count(self.fps[1:] ^ self.fps[:-1]).sum(1, dtype=np.int64) <= distance)
            yield self.order[near], self.order[near + 1]
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > _CHUNK:
                for lo in range(0, len(a), _CHUNK):
                    stack.append((level, a[lo : lo + _CHUNK], b[lo : lo + _CHUNK]))
                continue
            mask, pattern = self.levels[level]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]).sum(1, dtype=np.int64) <= distance
            a, b = a[near], b[near]
            if not len(a):
                continue
            if level:
                width, step = len(self.levels[level - 1][0]), np.arange(_FAN)
                x = np.repeat(a * _FAN, _FAN * _FAN).reshape(-1, _FAN, _FAN) + step[None, :, None]
                y = np.repeat(b * _FAN, _FAN * _FAN).reshape(-1, _FAN, _FAN) + step[None, None, :]
                x, y = x.ravel(), y.ravel()
                ok = (x < width) & (y < width) & (x <= y)
                stack.append((level - 1, x[ok], y[ok]))
                continue
            for lo in range(0, len(a), 256):
                p, q = a[lo : lo + 256], b[lo : lo + 256]
                if forest is not None:
                    ok = self._apart(p, q, forest)
                    p, q = p[ok], q[ok]
                rows, cols = p[:, None] * _LEAF + np.arange(_LEAF), q[:, None] * _LEAF + np.arange(_LEAF)
                apart = np.zeros((len(p), _LEAF, _LEAF), np.int16)
                for k in range(self.fps.shape[1]):
                    word = self.fps[:, k]
                    apart += np.bitwise_count(word[np.minimum(rows, self.n - 1)][:, :, None] ^ word[np.minimum(cols, self.n - 1)][:, None, :])
                k, i, j = np.nonzero(apart <= distance)
                x, y = rows[k, i], cols[k, j]
                ok = (x < y) & (y < self.n)
                if ok.any():
                    yield self.order[x[ok]], self.order[y[ok]]


def _small(fps: np.ndarray, bucket: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets of at most a leaf, all buckets at once; rows come by bucket."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for step in range(1, _LEAF):
        a = np.flatnonzero(bucket[step:] == bucket[:-step]) if step < len(bucket) else np.zeros(0, np.int64)
        if not len(a):
            break
        a = a[np.bitwise_count(fps[a] ^ fps[a + step]).sum(1, dtype=np.int64) <= distance]
        found.append((a, a + step))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest_of(bucket: np.ndarray, fps: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of a spanning forest of the links within buckets, whose rows stand together."""
    own, place = np.unique(node, return_inverse=True)
    forest = _Forest(len(own))
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.concatenate([cuts, [len(bucket)]]))
    few = np.flatnonzero(np.repeat(sizes <= _LEAF, sizes))
    a, b = _small(fps[few], bucket[few], distance)
    forest.join(place[few[a]], place[few[b]])
    for k in np.flatnonzero(sizes > _LEAF).tolist():
        lo, hi = int(cuts[k]), int(cuts[k] + sizes[k])
        here = _Forest(hi - lo)
        for a, b in GrayIndex(fps[lo:hi]).links(distance, here):
            here.join(a, b)
        roots = here.roots()
        forest.join(place[lo:hi], place[lo + roots])
    roots = forest.roots()
    linked = np.flatnonzero(roots != np.arange(len(own)))
    return own[linked], own[roots[linked]]


def _dealt(tables: list[np.ndarray], lanes: int):
    """A row for each table that a fingerprint is in."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _words_of(batch.column(0), lanes)
            bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little").astype(np.int64)
            for t, at in enumerate(tables):
                key = bits[:, at] @ (np.int64(1) << np.arange(len(at), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), t, np.int32)), pa.array(key), batch.column(0), batch.column(1)], ["tbl", "key", "fp", "node"])

    return mapped


def _forests(like: Similarity):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(rows: pa.Table) -> pa.RecordBatch:
            tbl, key, node = (rows.column(k).to_numpy() for k in (0, 1, 3))
            bucket = np.cumsum(np.concatenate([[0], (tbl[1:] != tbl[:-1]) | (key[1:] != key[:-1])])) if len(tbl) else tbl
            a, b = _forest_of(bucket, _words_of(rows.column(2), like.lanes), node, like.distance)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) < _HELD:
                continue
            rows = pa.Table.from_batches(held)
            tbl, key = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            cut = np.flatnonzero((tbl != tbl[-1]) | (key != key[-1]))  # the last bucket may go on
            if len(cut):
                yield linked(rows.slice(0, int(cut[-1]) + 1))
                held = rows.slice(int(cut[-1]) + 1).to_batches()
        if held:
            yield linked(pa.Table.from_batches(held))

    return mapped


def components(edges: DataFrame) -> DataFrame:
    """v and root (the smallest id reachable) of every vertex that isn't its own root. edges: a, b long.

    Alternates large and small stars until nothing moves, some log2(vertices) squared rounds at most; each
    round is written tables. The centre of a star may have a third of all edges, so both joins broadcast
    what hot vertices need.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("root").alias("v"), F.col("v").alias("root")))
        least = written(both.groupBy("v").agg(F.min("root").alias("m"), F.count(F.lit(1)).alias("n")).select("v", F.least("v", "m").alias("m"), "n"))
        large = written(hot_join(both, least, "v", "root").where("root > v").select(F.col("root").alias("v"), F.col("m").alias("root")).distinct())
        below = written(large.groupBy("v").agg(F.min("root").alias("m"), F.count(F.lit(1)).alias("n")))
        small = hot_join(large, below, "v", "root").select(F.col("root").alias("x"), "m", "v")
        stars = small.where("x <> m").select(F.col("x").alias("v"), F.col("m").alias("root")).union(below.select("v", F.col("m").alias("root"))).distinct()
        edges, before = written(stars), edges
        forget(before, least, large, below)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "root").cast("decimal(20,0)"))).first()
        if tuple(now) == state:
            return edges
        state = tuple(now)


def _roots(distinct: DataFrame, like: Similarity) -> DataFrame:
    """(v, root) of every fingerprint's node that isn't its component's smallest. distinct: (fp, node)."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = like.tables(distinct.count())
    dealt = distinct.select("fp", "node").mapInArrow(_dealt(tables, like.lanes), "tbl int, key long, fp binary, node long")
    met = dealt.repartition(parts, "tbl", "key").sortWithinPartitions("tbl", "key")
    return components(met.mapInArrow(_forests(like), "a long, b long"))


def near_groups(docs: DataFrame, like: Similarity = NARROW, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links, itself included) of every row.

    Null and blank texts have fingerprint zero and are linked like any other. Rows that repeat a doc_id
    get one row each. A null doc_id never names a component, unless all of its component's are null.
    An empty table gives no rows; other columns are ignored.
    """
    marked = written(fingerprints(docs, like, text=text, doc_id=doc_id))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")).where("node is not null"))
    roots = _roots(distinct, like)
    named = distinct.join(roots.select(F.col("v").alias("node"), "root"), "node", "left").where("n > 1 or root is not null")
    found = hot_join(marked, written(named.select("fp", F.coalesce("root", "node").alias("component_id"), "n")), "fp", "doc_id")
    return found.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, like: Similarity = WIDE, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs with one row of each component: the one with the smallest doc_id, null ones last,
    then the first in the table. All columns stay as they are."""
    rows = numbered(docs)
    marked = written(fingerprints(rows.select("row", F.col(f"all.`{text}`").alias("text")), like, doc_id="row").withColumnRenamed("doc_id", "row"))
    distinct = written(marked.groupBy("fp").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")))
    roots = _roots(distinct, like)
    named = distinct.join(roots.select(F.col("v").alias("node"), "root"), "node", "left").where("n > 1 or root is not null")
    grouped = hot_join(marked, written(named.select("fp", F.coalesce("root", "node").alias("root"), "n")), "fp", "row").select("row", F.coalesce("root", "row").alias("root"))
    # a row without company is its own component
    ids = written(rows.select("row", F.col(f"all.`{doc_id}`").cast("long").alias("id")).join(grouped, "row"))
    best = ids.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("best"))
    gone = written(ids.join(best.select("best.row"), "row", "left_anti").select("row"))
    forget(marked, distinct, ids)
    return rows.join(gone.hint("merge"), "row", "left_anti").select("all.*")


def brute_force(texts: dict[int, str | None], like: Similarity = NARROW) -> dict[int, tuple[int, int]]:
    """Fingerprint and component of each document by counting bits one by one and comparing all; for tests."""
    import re

    import xxhash

    ids, fps = sorted(texts), {}
    for d in ids:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[d] or "")
        tokens = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(tokens[k : k + like.words]) for k in range(max(1, len(tokens) - like.words + 1))] if tokens else []
        found = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
        for k in range(1, like.lanes):
            found = [h if k > 1 else [h] for h in found]
            found = [[*h, int(_mixed(np.array([h[0]], np.uint64), _LANES[k - 1])[0])] for h in found]
        value = 0
        for bit in range(64 * like.lanes):
            lane, at = divmod(bit, 64)
            ones = sum(((h[lane] if isinstance(h, list) else h) >> at) & 1 for h in found)
            value |= (2 * ones > len(found)) << (64 * (like.lanes - 1 - lane) + at)
        fps[d] = value
    root = {d: d for d in ids}
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if root[a] != root[b] and bin(fps[a] ^ fps[b]).count("1") <= like.distance:
                    root[a] = root[b] = min(root[a], root[b])
                    moved = True
    return {d: (fps[d], root[d]) for d in ids}
