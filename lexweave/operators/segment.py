"""Applying vocabularies row by row, in Arrow batches: what has no bound in column expressions.

A batch's distinct texts are segmented once. No row needs another, so the same code runs over streams.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import CONTINUES, WP_UNK
from .lattice import Trie


class Greedy:
    """The longest piece in the vocabulary at each place; a dead end makes the whole word [UNK]. Tries give
    the longest piece at every place of all words in step; all words then jump from piece to piece together,
    so the time is linear in the text for a given longest piece."""

    def __init__(self, vocab: list[str], block: int = 1 << 20):
        heads, tails = list(dict.fromkeys(vocab)), list(dict.fromkeys(t.removeprefix(CONTINUES) for t in vocab if t.startswith(CONTINUES)))
        self.heads, self.tails, self.block = Trie(heads), Trie(tails), block
        self.names = pa.array([*heads, *(CONTINUES + t for t in tails), WP_UNK], pa.string())

    @staticmethod
    def _longest(trie: Trie, letters: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """At each place the length of the longest piece (0 without one) and its number, from `first` on."""
        size, piece = np.zeros(len(letters), np.int64), np.zeros(len(letters), np.int64)
        for length, start, found in trie.walks(letters):  # longer ones come later
            size[start], piece[start] = length, found + first
        return size, piece

    def __call__(self, words: list[str]) -> pa.Array:
        """The pieces of each word."""
        out, lo = [], 0
        sizes = np.cumsum([0, *(len(w) + 1 for w in words)])
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + self.block, "right")) - 1)
            out.append(self._some(words[lo:hi]))
            lo = hi
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    def _some(self, words: list[str]) -> pa.Array:
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size + 1) - size - 1
        ends, text = first + size, "\0".join([*words, ""])
        letters = [trie.letters(text) for trie in (self.heads, self.tails)]
        for x in letters:
            x[ends] = 0
        head_size, head = self._longest(self.heads, letters[0], 0)
        tail_size, tail = self._longest(self.tails, letters[1], len(self.heads.vocab))
        word, at = np.flatnonzero(size), first[size > 0]
        step, piece = head_size[at], head[at]
        lost, owners, pieces = np.zeros(len(words), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(word):
            lost[word[step == 0]] = True
            owners.append(word)
            pieces.append(piece)
            at = at + step
            on = (step > 0) & (at < ends[word])
            word, at = word[on], at[on]
            step, piece = tail_size[at], tail[at]
        owner, found = np.concatenate(owners), np.concatenate(pieces)
        keep = ~lost[owner]
        owner, found = np.concatenate([owner[keep], np.flatnonzero(lost)]), np.concatenate([found[keep], np.full(int(lost.sum()), len(self.names) - 1)])
        order = np.argsort(owner, kind="stable")
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(len(words) + 1)), pa.int32()), self.names.take(pa.array(found[order])))


class Replay:
    """Every rule in order, each once over the text, left to right. Pairs wait in a queue by the rank of the
    next rule that fits them, so rules without a place cost nothing."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.ranks: dict[tuple[str, str], list[int]] = {}
        for rank, (a, b, _) in enumerate(rules):
            self.ranks.setdefault((a, b), []).append(rank)
        self.merged = [m for _, _, m in rules]

    def _next(self, left: str, right: str, past: int) -> int:
        ranks = self.ranks.get((left, right))
        if not ranks or ranks[-1] <= past:
            return -1
        return ranks[bisect.bisect_right(ranks, past)]

    def __call__(self, tokens: list[str]) -> list[str]:
        token: list[str | None] = list(tokens)
        n = len(token)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := self._next(token[i], token[i + 1], -1)) >= 0]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i] if token[i] is not None else -1
            if j < 0 or rank not in self.ranks.get((token[i], token[j]), ()):
                continue
            token[i], token[j] = self.merged[rank], None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] >= 0 and (r := self._next(token[p], token[after[p]], rank)) >= 0:
                    heapq.heappush(queue, (r, p))
        return [t for t in token if t is not None]


def each(cut: Callable[[str], list[str]]) -> Callable[[list[str]], pa.Array]:
    """A function of one text as one of many."""
    return lambda texts: pa.array([cut(t) for t in texts], pa.list_(pa.string()))


def segmented(rows: DataFrame, column: str, make: Callable[[], Callable[[list[str]], pa.Array]]) -> DataFrame:
    """rows with `tokens` of a text column beside them; null is empty. `make` builds, once a task, the function
    that segments a batch's distinct texts."""
    names = [c for c in rows.columns if c != "tokens"]
    rows = rows.select(*[F.col(f"`{c}`") for c in names])
    place = names.index(column)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = make()
        for batch in batches:
            coded = batch.column(place).fill_null("").dictionary_encode()
            found = cut(coded.dictionary.to_pylist())
            tokens = found.take(pa.array(np.asarray(coded.indices), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*names, "tokens"])

    return rows.mapInArrow(mapped, StructType([*rows.schema.fields, StructField("tokens", ArrayType(StringType()))]))
