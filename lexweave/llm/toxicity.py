"""Toxicity scores from a factorisation machine over hashed terms.

An additive model weighs each term alone. Here each pair of terms that stand in one document has a weight
too, the product of their latent vectors, so that an insult beside the mention of a group can count for
more than the two apart:

    y = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]

x_i is 1 + ln(occurrences) of term i, for terms that enough learned documents hold; all pairs together cost
linear time. Terms are runs of letters and digits with A-Z lower-cased, hashed over whole buffers, so no
Python code runs per word, and long texts are cut between words, so memory doesn't grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import segment_sums, text_buffers

_BASE = 0x9E3779B97F4A7C15
#: Bytes of text hashed at a time.
SPAN = 1 << 20
#: A-Z become a-z, and which bytes belong to a term: digits, a-z, and all above ASCII.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_INSIDE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in _LOWER.tolist()])


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SPAN, base, np.uint64))])


_tables: list[np.ndarray] = []


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words [start, end) of a span."""
    if not _tables:
        _tables.extend((_powers(_BASE), _powers(pow(_BASE, -1, 2**64))))
    up, down = _tables
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * down[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _spans(inside: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of at most SPAN bytes, at ends of texts or between words; a word longer than that is cut itself."""
    lo, n = 0, len(inside)
    while lo < n:
        hi = min(n, lo + SPAN)
        if hi < n:
            k = int(np.searchsorted(offsets, hi, "right")) - 1
            if offsets[k] > lo:
                hi = int(offsets[k])
            else:
                blank = np.flatnonzero(~inside[lo:hi])
                hi = lo + int(blank[-1]) + 1 if len(blank) else hi
        yield lo, hi
        lo = hi


def hashed_terms(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, occurrences, row starts) of the terms of each text, buckets ascending within a row."""
    lowered = _LOWER[raw]
    inside = _INSIDE[lowered]
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in _spans(inside, offsets):
        here = inside[lo:hi]
        cut = offsets[(offsets > lo) & (offsets < hi)] - lo
        begins, ends = here.copy(), here.copy()
        begins[1:] &= ~here[:-1]
        begins[cut] = here[cut]
        ends[:-1] &= ~here[1:]
        ends[cut - 1] = here[cut - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        row = np.searchsorted(offsets, starts + lo, "right") - 1
        bucket = (_hashes(lowered[lo:hi], starts, stops) % np.uint64(buckets)).astype(np.int64)
        key, count = np.unique(row * buckets + bucket, return_counts=True)
        keys.append(key)
        sums.append(count)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(place, np.concatenate(sums), len(key)).astype(np.int64)
    return key % buckets, count, np.searchsorted(key // buckets, np.arange(len(offsets)))


@dataclass
class Machine:
    """Weights of the terms kept, by slot; `slot` gives the slot of each bucket, -1 without one."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray  # the same rows, `rank` columns
    slot: np.ndarray

    def inputs(self, idx: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, x, row starts) of the terms kept."""
        slot = self.slot[idx]
        kept = slot >= 0
        return slot[kept], 1 + np.log(count[kept]), np.concatenate([[0], np.cumsum(kept)])[at]

    def margin(self, idx: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        slot, x, at = self.inputs(idx, count, at)
        one, two = self.interactions(slot, x, at)
        return self.bias + segment_sums(self.linear[slot] * x, at) + 0.5 * (one**2 - two).sum(1)

    def interactions(self, slot: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row and factor the sum of v x, and that of their squares."""
        part = self.factors[slot] * x[:, None]
        return segment_sums(part, at), segment_sums(part**2, at)


def screened(idx: np.ndarray, at: np.ndarray, label: np.ndarray, buckets: int, least: int, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each bucket and the log odds of its presence. A term has a slot if `least` documents hold
    it and their labels stand `apart` standard errors or more from what chance gives; the others would only
    add noise in proportion to a text's length."""
    n, marked = len(label), label.sum()
    held = np.bincount(idx, minlength=buckets)
    hits = np.bincount(idx, np.repeat(label, np.diff(at)), buckets)
    share = marked / n
    kept = (held >= least) & (np.abs(hits - held * share) >= apart * np.sqrt(np.maximum(held * share * (1 - share), 1e-12)))
    odds = np.log((hits[kept] + 0.5) / (marked + 1)) - np.log((held[kept] - hits[kept] + 0.5) / (n - marked + 1))
    slot = np.full(buckets, -1, np.int64)
    slot[kept] = np.arange(int(kept.sum()))
    return slot, odds


def fit(idx: np.ndarray, count: np.ndarray, at: np.ndarray, label: np.ndarray, *, buckets: int, rank: int = 4, least: int = 3, apart: float = 3.0, epochs: int = 30, rate: float = 0.1, decay: float = 1e-5, batch: int = 64, prior: float = 0.25, weight: float = 3.0, seed: int = 1) -> Machine:
    """Logistic loss in which rows of label 1 weigh `weight`, AdaGrad steps over the terms of each mini-batch.
    Linear weights start at `prior` times the log odds. The same rows in the same order give the same machine."""
    if not len(label) or label.min() == label.max():
        return Machine(0.0 if not len(label) else (3.0 if label[0] else -3.0), np.zeros(0), np.zeros((0, rank)), np.full(buckets, -1, np.int64))
    rng = np.random.default_rng(seed)
    slot, odds = screened(idx, at, label, buckets, least, apart)
    m = Machine(float(np.log(label.mean() / (1 - label.mean()))), prior * odds, rng.normal(0, 0.01, (len(odds), rank)), slot)
    slots, x, at = m.inputs(idx, count, at)
    seen_bias, seen_linear, seen_factors = 1e-6, np.full(len(odds), 1e-6), np.full((len(odds), rank), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), batch):
            rows = np.sort(order[lo : lo + batch])
            sizes = at[rows + 1] - at[rows]
            local = np.concatenate([[0], np.cumsum(sizes)])
            take = np.repeat(at[rows] - local[:-1], sizes) + np.arange(local[-1])
            s, v = slots[take], x[take]
            one, two = m.interactions(s, v, local)
            y = m.bias + segment_sums(m.linear[s] * v, local) + 0.5 * (one**2 - two).sum(1)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[rows]) * np.where(label[rows] > 0, weight, 1.0) / len(rows)
            owner = np.repeat(np.arange(len(rows)), sizes)
            used, place = np.unique(s, return_inverse=True)
            pull = g[owner] * v
            bend = pull[:, None] * (one[owner] - m.factors[s] * v[:, None])
            linear = np.bincount(place, pull, len(used)) + decay * (m.linear[used] - prior * odds[used])
            factors = np.stack([np.bincount(place, bend[:, f], len(used)) for f in range(rank)], axis=1) + decay * m.factors[used]
            seen_linear[used] += linear**2
            seen_factors[used] += factors**2
            seen_bias += g.sum() ** 2
            m.linear[used] -= rate * linear / np.sqrt(seen_linear[used])
            m.factors[used] -= rate / 2 * factors / np.sqrt(seen_factors[used])
            m.bias -= rate * g.sum() / np.sqrt(seen_bias)
    return m


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", most_rows: int = 16_000, buckets: int = 1 << 18, rank: int = 4, text: str = "text", doc_id: str = "doc_id") -> Machine:
    """A machine from at most `most_rows` labelled rows, those with the smallest hash of their id, then of
    their terms. Rows without a label or id are left out; of several labels the smallest counts."""
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    early = F.shiftrightunsigned(F.xxhash64("doc_id"), 2) <= int(min(1.0, most_rows / max(1, marks.count())) * (2**62 - 1))
    bodies = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(early)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, count, at = hashed_terms(*text_buffers(batch.column(2)), buckets)
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v.astype(np.int32))) for v in (idx, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "label", "bucket", "times"])

    # about most_rows ids, so the broadcast is bounded; rows that repeat an id are cut off by the limit
    terms = bodies.join(F.broadcast(marks.where(early)), "doc_id").select("doc_id", "label", "text").mapInArrow(mapped, "doc_id long, label int, bucket array<int>, times array<int>")
    got = terms.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("bucket", "times")).limit(most_rows).select("label", "bucket", "times").toArrow().combine_chunks()
    one = lambda name: got[name].combine_chunks() if isinstance(got[name], pa.ChunkedArray) else got[name]
    sizes = np.array([len(x) for x in one("bucket")], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = lambda name: np.asarray(one(name).flatten()).astype(np.int64)
    return fit(flat("bucket"), flat("times"), at, (np.asarray(one("label")) > 0).astype(np.float64), buckets=buckets, rank=rank)


def score(docs: DataFrame, machine: Machine, *, threshold: float = 0.7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from `threshold` on) of every row's whole text.

    Null and empty texts, and texts without a term that the machine keeps, get the score of its bias; a
    machine that learned nothing scores 0.5. Repeated rows get one row each, equal texts equal scores; an
    empty table gives none; a null doc_id stays null. Other columns, whatever their names, are ignored.
    """
    buckets, shared = len(machine.slot), docs.sparkSession.sparkContext.broadcast(machine)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine = shared.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            out, lo = [np.zeros(0)], 0
            while lo < batch.num_rows:  # a few texts at a time bound the memory
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 4 * SPAN, "right")) - 1)
                out.append(machine.margin(*hashed_terms(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], buckets)))
                lo = hi
            value = 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(mapped, "doc_id long, score double, predicted int")
