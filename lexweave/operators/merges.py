"""Learning merge rules: one loop, three criteria.

Two executions give the same rules. The distributed one (guessed.py) keeps the weighted segmentations as a
table of texts, from their first rewriting on of held strings. The compact one is for histograms of bounded size, which is checked: the segmentations
become linked integer arrays with an index of where each pair stands, so a merge touches only its own places.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLOSE, CONTINUES, OPEN, UNK, held
from .points import parts, points, summed

#: Histograms of at most this many symbols are learned from in memory.
COMPACT_SYMBOLS = 6_000_000


@dataclass
class Merges:
    """Rules in order (left, right, merged), and the first vocabulary by first occurrence."""

    rules: list[tuple[str, str, str]]
    vocab: list[str]


def plain(left: str, right: str) -> str:
    return left + right


def continued(left: str, right: str) -> str:
    """The right piece gives up one continuation prefix."""
    return left + right.removeprefix(CONTINUES)


@dataclass
class Segments:
    """Weighted segmentations as arrays: token names, and each row's token numbers, size and weight."""

    names: list[str]
    ids: np.ndarray
    size: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(rows: list[tuple[list[str], int]]) -> Segments:
        names: dict[str, int] = {}
        ids = [names.setdefault(t, len(names)) for tokens, _ in rows for t in tokens]
        return Segments(list(names), np.array(ids, np.int64), np.array([len(t) for t, _ in rows], np.int64), np.array([n for _, n in rows], np.int64))

    @staticmethod
    def collected(segments: DataFrame) -> Segments:
        """Of a table (tokens, n) of bounded size."""
        table = segments.select(F.concat(F.lit(OPEN), F.array_join("tokens", CLOSE + OPEN), F.lit(CLOSE)).alias("s"), "n").toArrow()
        return Segments.split(table["s"], table["n"])

    @staticmethod
    def split(held: pa.ChunkedArray, weight: pa.ChunkedArray) -> Segments:
        """Of held segmentations and their weights."""
        lists = pc.split_pattern(pc.utf8_slice_codeunits(pc.cast(held, pa.large_string()), 1, -1), CLOSE + OPEN)
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.large_list(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        weight = weight.to_numpy()
        return Segments(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), sizes.astype(np.int64), weight.astype(np.int64))


@dataclass(frozen=True)
class Start:
    """How texts begin as tokens: a character each, those after the first with the continuation prefix if
    `continues`; with an alphabet, characters outside it as <unk>."""

    continues: bool = False
    known: tuple[str, ...] | None = None

    def segments(self, texts: pa.ChunkedArray, weight: pa.ChunkedArray, strict: bool = False) -> Segments:
        """With `strict`, texts that hold what parts held tokens are an error."""
        codes, sizes = points(texts)
        seen = np.flatnonzero(np.bincount(codes))
        names = [chr(c) for c in seen.tolist()]
        if strict and {OPEN, CLOSE} & {*names}:
            raise ValueError("texts to be segmented must not hold U+0001 or U+0002")
        number = np.zeros(int(seen[-1]) + 1 if len(seen) else 0, np.int64)
        if self.known is not None:
            known = {*self.known}
            kept = np.array([c in known for c in names], bool)
            names = [*(c for c in names if c in known), UNK]
            number[seen] = np.where(kept, np.cumsum(kept) - 1, len(names) - 1)
        else:
            number[seen] = np.arange(len(seen))
        ids = number[codes]
        if self.continues:
            first = (np.cumsum(sizes) - sizes)[sizes > 0]
            later = np.full(len(ids), len(names), np.int64)
            later[first] = 0
            ids, names = ids + later, [*names, *(CONTINUES + c for c in names)]
        return Segments(names, ids, sizes, weight.to_numpy().astype(np.int64))


def pair_sums(rows: Segments) -> tuple[list[str], list[str], np.ndarray]:
    """Left, right and sum of weights of the adjacent pairs."""
    width, weight = len(rows.names), np.repeat(rows.weight, rows.size)
    inner = np.ones(len(rows.ids), bool)
    inner[np.cumsum(rows.size)[rows.size > 0] - 1] = False
    at = np.flatnonzero(inner)
    code, c = summed(rows.ids[at] * width + rows.ids[np.minimum(at + 1, len(rows.ids) - 1)], weight[at])
    return [rows.names[k] for k in (code // width).tolist()], [rows.names[k] for k in (code % width).tolist()], c


def token_sums(names: list[str], ids: np.ndarray, weight: np.ndarray) -> tuple[list[str], np.ndarray]:
    sums = np.bincount(ids, weight, len(names)).astype(np.int64)
    seen = np.flatnonzero(np.bincount(ids, minlength=len(names)))
    return [names[k] for k in seen.tolist()], sums[seen]


def frequencies(texts: DataFrame, start: Start, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(token, c) of texts (s, n) after the rules: a block of texts is merged in linked arrays, and its tokens
    are summed where they are."""
    shared = texts.sparkSession.sparkContext.broadcast(rules)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in parts(batches):
            rows = LinkedSegments(start.segments(table["s"], table["n"], strict=True))
            for a, b, m in shared.value:
                left, right = rows.number.get(a), rows.number.get(b)
                if left is not None and right is not None:
                    rows.merge(left, right, m)
            at = np.flatnonzero(rows.symbol >= 0)
            token, c = token_sums(rows.names, rows.symbol[at], rows.weight[at])
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(c)], ["token", "c"])

    rows = texts.select("s", F.col("n").cast("long").alias("n"))
    return rows.mapInArrow(mapped, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def first_tokens(texts: DataFrame, start: Start) -> DataFrame:
    """(token, c): what texts (s, n) begin as."""
    return frequencies(texts, start, [])


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each begins in it. Small keys take linear time."""
    small = len(keys) and keys.max() < 1 << 16
    order = np.argsort(keys.astype(np.uint16) if small else keys, kind="stable")
    sorted_ = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(keys) else order


class LinkedSegments:
    """Segmentations in linked arrays, with the places of every pair. A place takes a pair at most once:
    its token only grows."""

    def __init__(self, rows: Segments):
        self.names = list(rows.names)
        self.number = {t: k for k, t in enumerate(self.names)}
        self.symbol = rows.ids.copy()
        self.weight = np.repeat(rows.weight, rows.size)
        total = len(self.symbol)
        self.after = np.arange(1, total + 1)
        self.before = np.arange(-1, total - 1)
        self.taken = np.zeros(total, bool)
        ends = np.cumsum(rows.size)[rows.size > 0]
        self.after[ends - 1] = -1
        self.before[np.concatenate([[0], ends[:-1]]) if len(ends) else ends] = -1
        self.places: dict[int, list[np.ndarray]] = {}
        self.count: dict[int, int] = {}
        self.tokens = dict(enumerate(np.bincount(self.symbol, self.weight, len(self.names)).astype(np.int64).tolist())) if total else {}
        self.touched: set[int] = set()
        at, v = np.flatnonzero(self.after >= 0), len(self.names)
        self._add(self.symbol[at] * v + self.symbol[self.after[at]], at, lambda k: (k // v << 32) | k % v)

    def copy(self) -> LinkedSegments:
        """One that can be merged apart from this one."""
        out = object.__new__(LinkedSegments)
        out.names, out.number, out.weight = list(self.names), dict(self.number), self.weight
        out.symbol, out.after, out.before, out.taken = (x.copy() for x in (self.symbol, self.after, self.before, self.taken))
        out.places, out.count, out.tokens, out.touched = {k: list(v) for k, v in self.places.items()}, dict(self.count), dict(self.tokens), set(self.touched)
        return out

    def intern(self, token: str) -> int:
        if token not in self.number:
            self.number[token] = len(self.names)
            self.names.append(token)
        return self.number[token]

    def _add(self, keys: np.ndarray, at: np.ndarray, code_of: Callable[[int], int]) -> None:
        """New pairs at these places; those with one key are one pair."""
        order, lead = _grouped(keys)
        if not len(order):
            return
        at, keys = at[order], keys[order]
        sums = np.add.reduceat(self.weight[at], lead)
        for key, s, a, b in zip(keys[lead].tolist(), sums.tolist(), lead.tolist(), [*lead[1:].tolist(), len(at)], strict=True):
            code = code_of(key)
            self.places.setdefault(code, []).append(at[a:b])
            self.count[code] = self.count.get(code, 0) + s
            self.touched.add(code)

    def _drop(self, keys: np.ndarray, at: np.ndarray, code_of: Callable[[int], int]) -> None:
        sums = np.bincount(keys, self.weight[at]).astype(np.int64) if len(keys) else keys
        for key in np.flatnonzero(sums).tolist():
            code = code_of(key)
            self.count[code] -= int(sums[key])
            self.touched.add(code)

    def merge(self, left: int, right: int, merged: str) -> int:
        """One pass, left to right, without overlap."""
        m, code = self.intern(merged), (left << 32) | right
        at = np.concatenate(self.places.pop(code, [np.zeros(0, np.int64)]))
        at = at[(self.symbol[at] == left) & (self.after[at] >= 0)]
        at = at[self.symbol[self.after[at]] == right]
        if left == right and len(at):
            at = np.sort(at)
            fresh = np.concatenate([[True], self.after[at[:-1]] != at[1:]])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone, prior = self.after[at], self.before[at]
        tail = self.after[gone] >= 0
        # a pair between two merged places counts as what follows the first of them
        self.taken[gone] = True
        lead = (prior >= 0) & ~self.taken[prior]
        self.taken[gone] = False
        prior, follow = prior[lead], at[tail]
        moved = int(self.weight[at].sum())
        self.count[code] = self.count.get(code, 0) - moved
        self.touched.add(code)
        self._drop(self.symbol[prior], prior, lambda x: (x << 32) | left)
        self._drop(self.symbol[self.after[gone[tail]]], follow, lambda y: (right << 32) | y)
        self.symbol[at], self.symbol[gone] = m, -1
        self.after[at] = self.after[gone]
        self.before[self.after[follow]] = follow
        self.after[gone] = -1
        self._add(self.symbol[prior], prior, lambda x: (x << 32) | m)
        self._add(self.symbol[self.after[follow]], follow, lambda y: (m << 32) | y)
        for t, d in ((left, -moved), (right, -moved), (m, moved)):
            self.tokens[t] = self.tokens.get(t, 0) + d
        return m


def _by_frequency(state: LinkedSegments, least: int) -> Iterator[tuple[int, int]]:
    """Best pairs in turn: most frequent, then left, then right. Stale heap entries are skipped."""
    heap: list[tuple[int, str, str, int]] = []
    while True:
        for code in state.touched:
            if (c := state.count[code]) >= max(1, least):
                heapq.heappush(heap, (-c, state.names[code >> 32], state.names[code & 0xFFFFFFFF], code))
        state.touched.clear()
        while heap and state.count[heap[0][3]] != -heap[0][0]:
            heapq.heappop(heap)
        if not heap:
            return
        code = heapq.heappop(heap)[3]
        yield code >> 32, code & 0xFFFFFFFF


def _by_score(state: LinkedSegments, least: int) -> Iterator[tuple[int, int]]:
    """Best pairs in turn: highest c_ab / (c_a c_b), then left, then right."""
    slot: dict[int, int] = {}
    left, right, count = (np.zeros(1024, np.int64) for _ in range(3))
    while True:
        for code in state.touched:
            k = slot.setdefault(code, len(slot))
            if k == len(count):
                left, right, count = (np.concatenate([x, np.zeros(k, np.int64)]) for x in (left, right, count))
            left[k], right[k], count[k] = code >> 32, code & 0xFFFFFFFF, state.count[code]
        state.touched.clear()
        marginal = np.zeros(len(state.names) + 1)
        marginal[list(state.tokens)] = list(state.tokens.values())
        live = np.flatnonzero(count >= max(1, least))
        if not len(live):
            return
        score = count[live] / (marginal[left[live]] * marginal[right[live]])
        best = live[score == score.max()]
        pick = min(best.tolist(), key=lambda k: (state.names[left[k]], state.names[right[k]]))
        yield int(left[pick]), int(right[pick])


def learn_compact(rows: Segments, *, by_score: bool, least: int, done: Callable[[int, int], bool], join: Callable[[str, str], str], seeds: list[str]) -> list[tuple[str, str, str]]:
    """Rules until `done(number of rules, size of vocabulary)` or no pair is left."""
    state = LinkedSegments(rows)
    vocab, rules = set(seeds), []
    if done(0, len(vocab)):
        return rules
    for a, b in (_by_score if by_score else _by_frequency)(state, least):
        left, right = state.names[a], state.names[b]
        merged = join(left, right)
        rules.append((left, right, merged))
        vocab.add(merged)
        state.merge(a, b, merged)
        if done(len(rules), len(vocab)):
            break
    return rules


def learn(segments: DataFrame, *, by_score: bool = False, least: int = 2, done: Callable[[int, int], bool], join: Callable[[str, str], str] = plain, seeds: list[str] | None = None, compact_symbols: int = COMPACT_SYMBOLS, start: Start | None = None, **how) -> list[tuple[str, str, str]]:
    """Rules from segments (tokens, n), or from texts (s, n) and how they begin. Up to `compact_symbols`
    symbols in all are learned from in memory, after a count; more than that stay distributed."""
    from . import guessed

    segments = segments.where("s <> ''" if start else F.size("tokens") > 0)
    size = segments.agg(F.sum((F.length("s") if start else F.size("tokens")).cast("long"))).first()[0] or 0
    if size <= compact_symbols:
        if start:
            table = segments.select("s", "n").toArrow()
            rows = start.segments(table["s"], table["n"])
        else:
            rows = Segments.collected(segments)
        return learn_compact(rows, by_score=by_score, least=least, done=done, join=join, seeds=seeds or [])
    state = segments.select("s" if start else held(F.col("tokens")).alias("s"), F.col("n").cast("long").alias("n"))
    return guessed.learn(state, by_score=by_score, least=least, done=done, join=join, seeds=seeds or [], start=start, **how)
