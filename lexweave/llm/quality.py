"""Quality scores from a factorisation machine.

Inputs are hashed words (term frequencies, square-root damped), structure statistics of the text, and
length metadata computed from the text itself. Their pairwise interactions have rank `rank`:

    y = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]

which takes linear time. Word hashes come from prefix sums of a polynomial over whole buffers, so no
Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import segment_sums, text_buffers

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STATS = ["log_bytes", "upper", "digit", "punct", "symbol", "space", "high", "newline", "word_len", "long_word", "log_words", "distinct", "repeat", "excited"]
#: Byte classes: 1 upper, 2 digit, 3 sentence punctuation, 4 other symbols, 5 white space, 6 lower, 7 above ASCII, 8 newline
_CLASS = np.array([8 if b == 10 else 5 if b in (9, 11, 12, 13, 32) else 2 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 6 if 97 <= b <= 122 else 7 if b >= 128 else 3 if chr(b) in ".,;:?'\"-()" else 4 for b in range(256)], np.uint8)
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n + 1:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _powers[0] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            _powers[1] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse, np.uint64))])
    return _powers[0], _powers[1]


def featurise(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words (bucket, weight, row starts) and structure statistics of each text."""
    rows, n = len(offsets) - 1, len(raw)
    kind = _CLASS[raw]
    blank = (kind == 5) | (kind == 8)
    inside = ~blank
    begins = inside.copy()
    begins[1:] &= blank[:-1]
    first = offsets[:-1][(offsets[:-1] < n) & (np.diff(offsets) > 0)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    ends_mask = inside.copy()
    ends_mask[:-1] &= blank[1:] | begins[1:]
    ends = np.flatnonzero(ends_mask) + 1
    up, down = _power_tables(n)
    with np.errstate(over="ignore"):
        lowered = (raw | np.where(kind == 1, 32, 0).astype(np.uint8)).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(lowered * up[:n], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * down[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    row = np.searchsorted(offsets, starts, "right") - 1
    key = row.astype(np.int64) * buckets + (h % np.uint64(buckets)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    idx, owner = key % buckets, key // buckets
    words = np.bincount(row, minlength=rows)[:rows]
    weight = np.sqrt(count / np.maximum(1, words[owner]))
    at = np.searchsorted(owner, np.arange(rows + 1))
    size = np.maximum(1, np.diff(offsets)).astype(np.float64)
    share = lambda mask: segment_sums(mask.astype(np.int64), offsets) / size
    length = ends - starts
    per_word = np.maximum(1, words)
    total = np.bincount(row, length, minlength=rows)[:rows]
    long_ = np.bincount(row, length > 15, minlength=rows)[:rows]
    tail_kind = kind[ends - 1]
    odd_end = np.bincount(row, (tail_kind == 4) & (length > 1), minlength=rows)[:rows]
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (row[order[1:]] != row[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
    distinct = np.bincount(row[order[fresh]], minlength=rows)[:rows]
    top = np.zeros(rows)
    np.maximum.at(top, owner, count)
    stats = np.stack([np.log1p(np.diff(offsets)) / 10, share(kind == 1), share(kind == 2), share(kind == 3), share(kind == 4), share(blank), share(kind == 7), share(kind == 8), total / per_word / 10, long_ / per_word, np.log1p(words) / 10, distinct / per_word, top / per_word, odd_end / per_word], axis=1)
    return idx.astype(np.int64), weight, at, stats


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # buckets, then statistics
    factors: np.ndarray  # the same rows, `rank` columns
    mean: np.ndarray
    scale: np.ndarray
    buckets: int

    def margin(self, idx: np.ndarray, weight: np.ndarray, at: np.ndarray, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        v, s = self.factors[: self.buckets], self.factors[self.buckets :]
        y = self.bias + segment_sums(self.linear[idx] * weight, at) + z @ self.linear[self.buckets :]
        part = v[idx] * weight[:, None]
        one = segment_sums(part, at) + z @ s
        two = segment_sums(part**2, at) + (z**2) @ (s**2)
        return y + 0.5 * (one**2 - two).sum(1)


def fit(idx: np.ndarray, weight: np.ndarray, at: np.ndarray, stats: np.ndarray, label: np.ndarray, *, buckets: int, rank: int = 6, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, batch: int = 128, seed: int = 1) -> Machine:
    """Logistic loss, Adam steps over mini-batches of `batch` rows (a fortieth of fewer than 40 times as
    many); the same rows in the same order give the same machine."""
    batch = max(8, min(batch, len(label) // 40))
    rng = np.random.default_rng(seed)
    width = buckets + stats.shape[1]
    mean, scale = (stats.mean(0), stats.std(0) + 1e-6) if len(stats) else (np.zeros(stats.shape[1]), np.ones(stats.shape[1]))
    m = Machine(0.0, np.zeros(width), rng.normal(0, 0.01, (width, rank)), mean, scale, buckets)
    if not len(label) or label.min() == label.max():
        m.factors[:], m.bias = 0, 0.0 if not len(label) else (3.0 if label[0] else -3.0)
        return m
    m.bias = float(np.log(label.mean() / (1 - label.mean())))
    z_all = np.clip((stats - mean) / scale, -6, 6)
    params = [m.linear, m.factors]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), batch):
            rows = np.sort(order[lo : lo + batch])
            take = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])
            sizes = at[rows + 1] - at[rows]
            local = np.concatenate([[0], np.cumsum(sizes)])
            i, x, z = idx[take], weight[take], z_all[rows]
            v, s = m.factors[:buckets], m.factors[buckets:]
            part = v[i] * x[:, None]
            one = segment_sums(part, local) + z @ s
            y = m.bias + segment_sums(m.linear[i] * x, local) + z @ m.linear[buckets:] + 0.5 * (one**2 - segment_sums(part**2, local) - (z**2) @ (s**2)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[rows]) / len(rows)
            owner = np.repeat(np.arange(len(rows)), sizes)
            gl, gf = decay * m.linear, decay * m.factors
            np.add.at(gl, i, g[owner] * x)
            gl[buckets:] += g @ z
            np.add.at(gf, i, (g[owner] * x)[:, None] * (one[owner] - part))
            gf[buckets:] += np.einsum("r,rs,rf->sf", g, z, one) - (s * ((z**2).T @ g)[:, None])
            m.bias -= rate * g.sum()
            step += 1
            for p, d, a, b in zip(params, (gl, gf), first, second, strict=True):
                a *= 0.9
                a += 0.1 * d
                b *= 0.999
                b += 0.001 * d**2
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most_rows: int = 6000, buckets: int = 4096, rank: int = 6, text: str = "text", doc_id: str = "doc_id") -> Machine:
    """A machine from at most about `most_rows` labelled documents (those with the smallest hash of
    their id). Rows without a label or id are left out; of several labels the smallest counts."""
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    n = marks.count()
    share = int(min(1.0, most_rows / max(1, n)) * (2**62 - 1))
    marks = marks.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) <= share)
    bodies = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) <= share)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, weight, at, stats = featurise(*text_buffers(batch.column(2)), buckets)
            cut = lambda v: [v[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut(idx), pa.list_(pa.int64())), pa.array(cut(weight), pa.list_(pa.float64())), pa.array(stats.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "idx", "weight", "stats"])

    rows = bodies.join(F.broadcast(marks), "doc_id").select("doc_id", "label", "text").mapInArrow(mapped, "doc_id long, label int, idx array<long>, weight array<double>, stats array<double>")
    got = sorted(rows.toLocalIterator(), key=lambda r: (r["doc_id"], r["stats"]))
    at = np.concatenate([[0], np.cumsum([len(r["idx"]) for r in got])]).astype(np.int64)
    flat = lambda c, kind: np.array([x for r in got for x in r[c]], kind)
    return fit(flat("idx", np.int64), flat("weight", np.float64), at, np.array([r["stats"] for r in got], np.float64).reshape(-1, len(_STATS)), np.array([min(1, max(0, r["label"])) for r in got], np.float64), buckets=buckets, rank=rank)


def score(docs: DataFrame, machine: Machine, *, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from `threshold` on) of every row's whole text.

    Null texts count as empty and are scored by their statistics alone; a machine that learned nothing
    scores 0.5. Repeated rows get one row each; an empty table gives none; a null doc_id stays null. Other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine = shared.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            out, lo = [], 0
            while lo < batch.num_rows:  # a few texts at a time bound the memory
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1)
                out.append(machine.margin(*featurise(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], machine.buckets)))
                lo = hi
            value = 1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.zeros(0), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(mapped, "doc_id long, score double, predicted int")
