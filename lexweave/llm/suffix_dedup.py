"""Suffix dedup: bytes covered by a string of `width` bytes that also starts earlier.

A suffix array over everything would not fit any budget, so most suffixes are ruled out first. In each
window of `width` bytes the k-mer with the smallest hash is its anchor; equal windows have equal anchors
at equal places. Neighbouring windows with one anchor form a run. Runs meet by anchor in suffix buckets:

* Runs whose whole bytes agree (one 128-bit digest over them) repeat the first of them. Copies inside
  one block of documents are told on the spot and don't travel.
* An anchor that only one kind of run has is unique: its windows start nowhere else.
* What is left are runs that agree only in part, at the ends of repeated passages. Their bytes are
  fetched, and the suffixes of one bucket at a time are sorted by difference-cover blockwise
  construction: by their first bytes, then ties by the precomputed ranks of a cover sample, at the
  distance where both suffixes meet the sample. Neighbours in that order that share `width` bytes are
  equal windows. Runs of a single anchor that would overfill a block are compared one distance to the
  anchor at a time instead, byte by byte.

Buckets of runs and of texts are sized by bytes, so there are many to a partition; a task holds one of
them, and one text, at a time. Positions are bytes of the whole UTF-8 text; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written

WIDTH, KMER = 100, 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LAST = 2**63 - 1
#: Low bits of a k-mer's hash that give way to its place in the block; a block is shorter than 2^24.
_PLACE = np.uint64(24)
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n + 1:
        size = max(n, 1 << 21)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _tables[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (_BASE, inverse)]
    return _tables[0], _tables[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x


def runs_of(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: document, first and last start (in the document), anchor's
    place after the first start, anchor hash."""
    n, reach = len(raw), width - kmer + 1
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if n >> int(_PLACE):
        raise ValueError("a block must be shorter than 2^24 bytes")
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        grams = _mixed((prefix[kmer:] - prefix[:-kmer]) * down[: n - kmer + 1])
    low = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    anchor = (low & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)  # of each window start
    sizes = np.diff(offsets)
    long_ = np.flatnonzero(sizes >= width)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, offsets[long_], 1)
    np.add.at(edge, offsets[long_ + 1] - width + 1, -1)
    valid = np.cumsum(edge[: len(anchor)]) > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    new[offsets[long_]] = True
    lo = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    hi = np.flatnonzero(stop)
    at = anchor[lo]
    doc = np.searchsorted(offsets, lo, "right") - 1
    base = offsets[doc]
    return doc, lo - base, hi - base, at - lo, grams[at]


#: One run as it travels to its bucket; w1 and w2 are the digest of its bytes.
_RUN = np.dtype([("key", "<u8"), ("w1", "<u8"), ("w2", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("lo", "<u4"), ("span", "u1"), ("off", "u1")])
#: A range of bytes to remove, or with off < 255 a run whose bytes are asked for.
_MARK = np.dtype([("doc", "<i8"), ("text", "<i8"), ("lo", "<u4"), ("end", "<u4"), ("key", "<u8"), ("off", "u1")])
#: What a row of a shuffle is: a range to remove, bytes asked for, a text (last in its bucket).
_CUT, _ASK, _TEXT = 1, 2, 9


def _packed(rows: np.ndarray) -> bytes:
    """Column after column, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names)


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    out = np.empty(len(blob) // kind.itemsize, kind)
    at = 0
    for name in kind.names:
        step = len(out) * kind[name].itemsize
        out[name] = np.frombuffer(blob, kind[name], len(out), at)
        at += step
    return out


def _blocks(batches: Iterator[pa.RecordBatch], limit: int, width: int) -> Iterator[tuple]:
    """(doc ids, text hashes, first window, bytes, offsets) of about `limit` bytes of text at a time, by
    doc id. A longer text comes in several parts, which overlap so that each window is in one of them."""
    held, size = [], 0

    def block(held: list[tuple[int, int, int, bytes]]) -> tuple:
        held.sort(key=lambda x: (x[0], x[2]))
        ids, keys, bases = (np.array([h[k] for h in held], np.int64) for k in range(3))
        return ids, keys, bases, b"".join(h[3] for h in held), np.concatenate([[0], np.cumsum([len(h[3]) for h in held])]).astype(np.int64)

    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            some = batch.slice(first, 256)
            for i, k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts_of(some.column(2)), strict=True):
                for at in range(0, len(t) - width + 1, limit):
                    part = t[at : at + limit + width - 1]
                    held.append((i, k, at, part))
                    size += len(part)
                    if size >= limit:
                        yield block(held)
                        held, size = [], 0
    if held:
        yield block(held)


def _blobs(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Rows of (bucket, kind, body)."""
    buckets, kinds, bodies = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(kinds, pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "kind", "body"])


def _marked(told: np.ndarray, width: int, asked: bool = False) -> np.ndarray:
    """The ranges of bytes of some runs: to remove, or to fetch."""
    marks = np.zeros(len(told), _MARK)
    for name in ("doc", "text", "lo", *(("key", "off") if asked else ())):
        marks[name] = told[name]
    marks["end"] = told["lo"] + told["span"] + width
    if not asked:
        marks["off"] = 255
    return marks


def _heads(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings runs of one kind together, earliest first, and, in that order, the place of
    each one's head."""
    order = np.lexsort((rows["lo"], rows["doc"], rows["w2"], rows["w1"], rows["key"]))
    own = rows[order]
    equal = np.zeros(len(rows), bool)
    equal[1:] = (own["key"][1:] == own["key"][:-1]) & (own["w1"][1:] == own["w1"][:-1]) & (own["w2"][1:] == own["w2"][:-1])
    return order, np.maximum.accumulate(np.where(equal, 0, np.arange(len(rows))))


def _deal(buckets: int, slots: int, width: int, limit: int):
    """Runs of each block to their buckets, and the block's own repeats to their documents."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for ids, keys, bases, body, offsets in _blocks(batches, limit, width):
            doc, lo, hi, off, key = runs_of(np.frombuffer(body, np.uint8), offsets, width)
            at = offsets[doc]
            whole = b"".join([digest(body[a:b]) for a, b in zip((lo + at).tolist(), (hi + at + width).tolist(), strict=True)])
            rows = np.empty(len(doc), _RUN)
            rows["key"], rows["doc"], rows["text"] = key, ids[doc], keys[doc]
            rows["w1"], rows["w2"] = np.frombuffer(whole, "<u8").reshape(-1, 2).T
            rows["lo"], rows["span"], rows["off"] = lo + bases[doc], hi - lo, off
            order, head = _heads(rows)
            rows = rows[order]
            # a row that stands twice under one doc_id doesn't repeat itself
            later = (rows["doc"] != rows["doc"][head]) | (rows["lo"] != rows["lo"][head])
            out = [(int(b), 0, _packed(g)) for b, g in _by(rows[~later], _bucket(rows["key"][~later], buckets))]
            out += _to_texts(_joined(_marked(rows[later], width)), _CUT, slots)
            if out:
                yield _blobs(out)

    return mapped


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    if not len(values):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=True))


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(values.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _by(rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for a, b in _stretches(bucket[order]):
        yield bucket[order[a]], rows[order[a:b]]


def _to_texts(marks: np.ndarray, kind: int, slots: int) -> list[tuple[int, int, bytes]]:
    """Marks by the bucket of the text they belong to."""
    return [(int(b), kind, _packed(g)) for b, g in _by(marks, marks["text"] % slots)]


def _joined(marks: np.ndarray) -> np.ndarray:
    """Ranges of one text that touch or overlap become one; the rows come in order."""
    if len(marks) < 2:
        return marks
    marks = marks[np.lexsort((marks["lo"], marks["text"], marks["doc"]))]
    new = np.ones(len(marks), bool)
    apart = (marks["doc"][1:] != marks["doc"][:-1]) | (marks["text"][1:] != marks["text"][:-1])
    # ends rise with starts within a text, up to ranges that lie inside others
    group = np.concatenate([[0], np.cumsum(apart)])
    shift = group * (int(marks["end"].max()) + 1)
    top = np.maximum.accumulate(marks["end"].astype(np.int64) + shift)
    new[1:] = apart | (marks["lo"].astype(np.int64)[1:] + shift[1:] > top[:-1])
    at = np.flatnonzero(new)
    out = marks[at].copy()
    out["end"] = np.maximum.reduceat(marks["end"], at)
    return out


_BLOBS = "bucket long, kind int, body binary"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Each bucket of a partition sorted by bucket, with its rows one by one. A bucket's rows must be used
    before the next bucket is asked for."""
    rows = (row for batch in batches for first in range(0, batch.num_rows, 64) for row in zip(*[c.to_pylist() for c in batch.slice(first, 64).columns], strict=True))
    ahead = next(rows, None)

    def mine(bucket: int) -> Iterator[tuple]:
        nonlocal ahead
        while ahead is not None and ahead[0] == bucket:
            yield ahead
            ahead = next(rows, None)

    while ahead is not None:
        yield ahead[0], mine(ahead[0])


def _meet(slots: int, width: int):
    """One suffix bucket at a time: later runs with equal bytes are repeats; the first of each kind is
    asked for its bytes if its anchor has several kinds. Marks pass through."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _buckets(batches):
            runs, out = [], []
            for bucket, kind, body in found:
                if kind:
                    out.append((bucket, kind, body))
                else:
                    runs.append(_unpacked(body, _RUN))
            rows = np.concatenate([np.zeros(0, _RUN), *runs])
            order = np.argsort(rows["key"], kind="stable")
            same = rows["key"][order[1:]] == rows["key"][order[:-1]]
            shared = (np.concatenate([[False], same]) | np.concatenate([same, [False]]))[: len(rows)]
            rows = rows[order[shared]]  # an anchor that stands once has nothing to compare
            order, head = _heads(rows)
            rows = rows[order]
            later = (rows["doc"] != rows["doc"][head]) | (rows["lo"] != rows["lo"][head])
            group = np.cumsum(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])[: len(rows)]) - 1
            kinds = np.bincount(group, head == np.arange(len(rows)))
            # rows that repeat the head's doc_id and place are asked for as well: they may be different texts
            ask = rows[~later & (kinds[group] > 1)]
            out += _to_texts(_joined(_marked(rows[later], width)), _CUT, slots) + _to_texts(_marked(ask, width, asked=True), _ASK, slots)
            if out:
                yield _blobs(out)

    return mapped


def difference_cover(v: int) -> np.ndarray:
    """Places modulo v such that any two residues reach the cover at one common distance."""
    cover, met = [0], {0}
    while len(met) < v:
        gain = lambda c: len(met | {(c - d) % v for d in cover} | {(d - c) % v for d in cover})
        best = max((c for c in range(v) if c not in cover), key=lambda c: (gain(c), -c))
        met |= {(best - d) % v for d in cover} | {(d - best) % v for d in cover}
        cover.append(best)
    return np.array(sorted(cover))


_V = 32
_COVER = difference_cover(_V)
_IN_COVER = np.isin(np.arange(_V), _COVER)
#: The distance at which suffixes of residues a and b both meet the cover.
_MEET = np.array([[next(d for d in range(_V) if _IN_COVER[(a + d) % _V] and _IN_COVER[(b + d) % _V]) for b in range(_V)] for a in range(_V)])


class Block:
    """Suffixes of one block of bytes, in order of their first bytes (at least `width` of them)."""

    def __init__(self, body: np.ndarray, width: int = WIDTH):
        self.width, self.words = width, -(-width // 8)
        n = len(body)
        padded = np.concatenate([body, np.zeros(8 * self.words + _V + 16, np.uint8)]).astype(np.uint64)
        word = padded.copy()
        for size in (1, 2, 4):  # eight bytes from each place, the first highest
            word = (word[: len(word) - size] << np.uint64(8 * size)) | word[size:]
        self.word, self.n = word, n
        places = np.arange(n + _V)
        sample = places[_IN_COVER[places % _V]]
        self.rank = np.zeros(n + 2 * _V, np.int64)
        self.rank[sample] = self._refined(sample, self.words)

    def _refined(self, at: np.ndarray, words: int) -> np.ndarray:
        """Dense ranks by the first 8 * words bytes: a word a round, only where ties are left."""
        rank, active = np.zeros(len(at), np.int64), np.arange(len(at))
        for w in range(words):
            if not len(active):
                break
            own, key = rank[active], self.word[at[active] + 8 * w]
            order = np.lexsort((key, own))
            own, key = own[order], key[order]
            split = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
            lead = np.flatnonzero(split)
            group = np.cumsum(split) - 1
            first = np.concatenate([[True], own[1:] != own[:-1]])
            start = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
            fresh = own + (lead[group] - start)  # a rank is the number of suffixes below
            rank[active[order]] = fresh
            sizes = np.diff(np.concatenate([lead, [len(own)]]))
            active = active[order][sizes[group] > 1]
        return rank

    def order(self, at: np.ndarray) -> np.ndarray:
        """The suffixes at `at`, sorted; `at` indexes the result."""
        rank = self._refined(at, _V // 8)
        todo = np.argsort(rank, kind="stable")
        while True:  # every tied group is split by a pivot of its own, all at once
            lead = np.flatnonzero(np.concatenate([[True], rank[todo[1:]] != rank[todo[:-1]]])) if len(todo) else todo
            sizes = np.diff(np.concatenate([lead, [len(todo)]]))
            tied = np.repeat(sizes > 1, sizes)
            if not tied.any():
                return np.argsort(rank, kind="stable")
            pivot = todo[np.repeat(lead + sizes // 2, sizes)][tied]
            group, mine = np.repeat(np.arange(len(lead)), sizes)[tied], todo[tied]
            i, j = at[mine], at[pivot]
            d = _MEET[i % _V, j % _V]
            sign = np.sign(self.rank[i + d] - self.rank[j + d])
            below = np.bincount(group, sign < 0, len(lead)).astype(np.int64)[group]
            even = np.bincount(group, sign == 0, len(lead)).astype(np.int64)[group]
            rank[mine] += np.where(sign < 0, 0, np.where(sign == 0, below, below + even))
            todo = mine[sign != 0]
            todo = todo[np.argsort(rank[todo], kind="stable")]

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the first `width` bytes agree."""
        out = np.ones(len(i), bool)
        for w in range(self.words):
            a, b = self.word[i + 8 * w], self.word[j + 8 * w]
            if left := 8 * (w + 1) - self.width if w == self.words - 1 else 0:
                a, b = a >> np.uint64(8 * left), b >> np.uint64(8 * left)
            out &= a == b
        return out


def repeats(rows: np.ndarray, bodies: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Marks of the windows, among those of the runs asked for, that an earlier one equals."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    windows = sizes - width + 1
    run = np.repeat(np.arange(len(rows)), windows)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[run] + inside
    block = Block(np.frombuffer(b"".join(bodies), np.uint8), width)
    order = block.order(at)
    tied = np.concatenate([[False], block.same(at[order[1:]], at[order[:-1]])])
    group = np.cumsum(~tied) - 1
    doc, start, text = rows["doc"][run][order], rows["lo"].astype(np.int64)[run][order] + inside[order], rows["text"][run][order]
    sorted_ = np.lexsort((start, doc, group))
    group, doc, start, text = group[sorted_], doc[sorted_], start[sorted_], text[sorted_]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
    later = (doc != doc[head]) | (start != start[head])
    marks = np.zeros(int(later.sum()), _MARK)
    marks["doc"], marks["text"], marks["lo"], marks["end"], marks["off"] = doc[later], text[later], start[later], start[later] + width, 255
    return _joined(marks)


def hot_repeats(rows: np.ndarray, bodies: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The same for runs of one anchor that are too many for a block: equal windows have their anchor at
    equal places, so windows of one distance to it are compared at a time, earliest first."""
    order = np.lexsort((rows["lo"].astype(np.int64) + rows["off"], rows["doc"]))
    lo, off, span = (rows[name][order].astype(np.int64) for name in ("lo", "off", "end"))
    span -= lo + width
    doc, marks = rows["doc"][order].tolist(), []
    for o in range(int((off - span).min()), int(off.max()) + 1):
        mine = np.flatnonzero((off >= o) & (off - span <= o))
        inside, first, told = (off[mine] - o).tolist(), {}, []
        for k, i in zip(mine.tolist(), inside, strict=True):
            here = (doc[k], int(lo[k]) + i)
            if first.setdefault(bodies[order[k]][i : i + width], here) != here:
                told.append((k, i))
        m = np.zeros(len(told), _MARK)
        if told:
            k, i = np.array(told).T
            m["doc"], m["text"], m["lo"], m["off"] = rows["doc"][order[k]], rows["text"][order[k]], lo[k] + i, 255
            m["end"] = m["lo"] + width
        marks.append(m)
    return _joined(np.concatenate(marks))


def _by_text(found: list[np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Marks of each (doc, text)."""
    if not found:
        return {}
    marks = np.concatenate(found)
    marks = marks[np.lexsort((marks["text"], marks["doc"]))]
    cuts = np.flatnonzero(np.concatenate([[True], (marks["doc"][1:] != marks["doc"][:-1]) | (marks["text"][1:] != marks["text"][:-1])])).tolist()
    return {(int(marks["doc"][a]), int(marks["text"][a])): marks[a:b] for a, b in zip(cuts, [*cuts[1:], len(marks)], strict=True)}


def _fetch(buckets: int):
    """The bytes of the runs asked for, from one bucket of texts at a time, to the anchors' buckets."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _buckets(batches):
            asked, wanted, parts = [], None, []
            for _, kind, body, key, doc, _ in found:
                if kind == _ASK:
                    asked.append(_unpacked(body, _MARK))
                    continue
                if wanted is None:  # texts come after all that is asked of them
                    wanted = _by_text(asked)
                if (mine := wanted.pop((doc, key), None)) is not None:  # of rows that repeat, one will do
                    parts.append((mine, [body[a:b] for a, b in zip(mine["lo"].tolist(), mine["end"].tolist(), strict=True)]))
            if not parts:
                continue
            rows, bodies = np.concatenate([p[0] for p in parts]), [b for p in parts for b in p[1]]
            bucket, out = _bucket(rows["key"], buckets), []
            order = np.argsort(bucket, kind="stable")
            for a, b in _stretches(bucket[order]):
                mine = order[a:b]
                out.append((int(bucket[mine[0]]), _ASK, len(mine).to_bytes(8, "little") + _packed(rows[mine]) + b"".join([bodies[k] for k in mine.tolist()])))
            yield _blobs(out)

    return mapped


def _compare(slots: int, width: int, block_bytes: int):
    """Runs with one anchor side by side: a block of whole anchors at a time."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _buckets(batches):
            rows, bodies = [], []
            for _, _, blob in found:
                n = int.from_bytes(blob[:8], "little")
                mine = _unpacked(blob[8 : 8 + n * _MARK.itemsize], _MARK)
                at = 8 + n * _MARK.itemsize + np.concatenate([[0], np.cumsum(mine["end"].astype(np.int64) - mine["lo"])])
                rows.append(mine)
                bodies += [blob[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            rows = np.concatenate(rows)
            order = np.argsort(rows["key"], kind="stable")
            rows, bodies = rows[order], [bodies[k] for k in order.tolist()]
            ends = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
            lo, marks = 0, []

            def block(a: int, b: int, rows=rows, bodies=bodies, marks=marks) -> None:
                if b > a:
                    marks.append(repeats(rows[a:b], bodies[a:b], width))

            for a, b in _stretches(rows["key"]):
                if ends[b] - ends[a] > block_bytes:
                    block(lo, a)
                    marks.append(hot_repeats(rows[a:b], bodies[a:b], width))
                    lo = b
                elif ends[b] - ends[lo] >= block_bytes:
                    block(lo, b)
                    lo = b
            block(lo, len(rows))
            out = _to_texts(_joined(np.concatenate(marks)), _CUT, slots)
            if out:
                yield _blobs(out)

    return mapped


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept_sha256", pa.string())])


def _finish():
    """What is left of each text, one at a time, after the marks of its bucket."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _buckets(batches):
            marks, spans, out = [], None, []
            for _, kind, body, key, _, doc in found:
                if kind != _TEXT:
                    marks.append(_unpacked(body, _MARK))
                    continue
                if spans is None:
                    spans = _by_text([_joined(np.concatenate(marks))] if marks else [])
                own = doc if doc is not None else _LAST
                cut = [(m[2], m[3]) for m in spans[own, key].tolist()] if (own, key) in spans else []
                kept, at = hashlib.sha256(), 0
                for a, b in [*cut, (len(body), len(body))]:
                    kept.update(body[at:a])
                    at = b
                out.append((doc, len(body), sum(b - a for a, b in cut), [{"first": a, "last": b} for a, b in cut], kept.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    return mapped


def _by_bucket(rows: DataFrame, parts: int, *then: str | Column) -> DataFrame:
    """Buckets dealt evenly to partitions, each bucket's rows together."""
    return rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket", *then)


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id", block_bytes: int = 1 << 20, local_bytes: int = 1 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed byte ranges, end exclusive), kept_sha256.

    A null or empty text has no bytes. A null doc_id stands after all others. Rows that share a doc_id
    count as one document: of equal strings the one that starts earlier stays, and those that start at
    the same place all stay, so repeated rows don't erase each other; a string that starts earlier in
    another document is removed from each of them. An empty table gives no rows; other columns are ignored.

    A bucket is about `bucket_bytes` of text or the runs of as much, cut into blocks of `local_bytes` and
    `block_bytes`. Only the runs of one anchor are never split: those that agree in part, some 140 bytes
    each, are compared in one task.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0
    buckets = max(parts, -(-size // bucket_bytes))
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).cast("long").alias("id"))
    rows = own.select("doc", F.xxhash64("doc", "text").alias("key"), "text", "id")
    # as many buckets of texts as of runs: what a block told of its own texts rides along to the next table
    dealt = rows.select("doc", "key", "text").mapInArrow(_deal(buckets, buckets, width, local_bytes), _BLOBS)
    met = written(_by_bucket(dealt, parts).mapInArrow(_meet(buckets, width), _BLOBS))
    bodies = rows.select(F.pmod("key", F.lit(buckets)).alias("bucket"), F.lit(_TEXT).alias("kind"), F.col("text").cast("binary").alias("body"), "key", "doc", "id")
    blank = [F.lit(None).cast("long").alias(c) for c in ("key", "doc", "id")]
    told = lambda kind: met.where(F.col("kind") == kind).select("*", *blank)
    asked = bodies.where(F.octet_length("body") >= width).union(told(_ASK))
    fetched = _by_bucket(asked, parts, "kind").mapInArrow(_fetch(buckets), _BLOBS)
    found = _by_bucket(fetched, parts).mapInArrow(_compare(buckets, width, block_bytes), _BLOBS)
    marks = found.select("*", *blank).union(told(_CUT))
    out = "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept_sha256 string"
    return _by_bucket(bodies.union(marks), parts, "kind").mapInArrow(_finish(), out)


def brute_force(texts: list[tuple[int, bytes]], width: int = WIDTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all strings; for tests. Ids are distinct."""
    seen: set[bytes] = set()
    out = {}
    for doc, body in sorted(texts):
        covered = np.zeros(len(body) + 1, np.int64)
        for i in range(len(body) - width + 1):
            piece = body[i : i + width]
            if piece in seen:
                covered[i] += 1
                covered[i + width] -= 1
            seen.add(piece)
        gone = np.cumsum(covered)[: len(body)] > 0
        left = bytes(np.frombuffer(body, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        out[doc] = (len(body), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest())
    return out
