"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts. A context with n symbols seen, q of them
different, gives a symbol seen c times probability c / (n + q) and an escape q / (n + q); after an
escape the next shorter context is asked, without the symbols already excluded, down to a uniform
order over 256 bytes. Statistics are frozen after learning, so the code length of a text is exact and
does not depend on how texts are batched: it is the sum, over its bytes, of the cost in the longest
context that the language's tree knows. The text is coded in the language that needs the fewest bits.

For scoring, the contexts of a few languages share one suffix tree, in which each (context, byte) has its
finished cost in each of them, so a byte takes one step a level and one look-up for all of these. A
language adds a bounded table to the model, at most contexts x symbols x 4 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, carried, segment_sums, text_buffers, texts_of

_LETTER = r"\p{L}"
UNKNOWN = "und"
#: Languages that share a tree.
_TOGETHER = 4


@dataclass
class PpmTree:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol number; bytes never seen share the last one
    child: np.ndarray  # context, symbol before it -> longer context, or -1
    cost: np.ndarray  # context, symbol, language -> bits
    order: int = 3

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        depth = self.order
        gap = np.arange(1, len(offsets)) * depth  # start-of-text symbols go before each text
        seq = np.full(len(raw) + gap[-1] if len(gap) else 0, self.start, np.int32)
        where = np.arange(len(raw)) + np.repeat(gap, np.diff(offsets))
        seq[where] = self.symbol[raw]
        node, live = np.zeros(len(raw), np.int32), where
        rows = np.arange(len(raw))
        for level in range(1, depth + 1):
            step = self.child[node[rows], seq[live - level]]
            ok = step >= 0
            rows, live = rows[ok], live[ok]
            node[rows] = step[ok]
        return segment_sums(self.cost[node, seq[where]].astype(np.float64), offsets)

    @property
    def start(self) -> int:
        return self.child.shape[1] - 1

    def classify(self, raw: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
        """bits(), over pieces of bounded size; a long text is cut, each piece keeping its contexts."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        lo = 0
        while lo < len(offsets) - 1:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
            a, b = offsets[lo], offsets[hi]
            if b - a <= chunk:
                out[lo:hi] = self.bits(raw[a:b], offsets[lo : hi + 1] - a)
            else:
                for s in range(a, b, chunk):
                    lead = min(self.order, s - a)
                    both = self.bits(raw[s - lead : min(b, s + chunk)], np.array([0, min(b, s + chunk) - s + lead]))
                    out[lo] += both[0] - (self.bits(raw[s - lead : s], np.array([0, lead]))[0] if lead else 0)
            lo = hi
        return out


@dataclass
class PpmModel:
    """Trees of a few languages each."""

    trees: list[PpmTree]

    @property
    def languages(self) -> list[str]:
        return [la for t in self.trees for la in t.languages]

    def classify(self, raw: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
        """Code length of each text in each language."""
        return np.concatenate([np.zeros((len(offsets) - 1, 0)), *[t.classify(raw, offsets, chunk) for t in self.trees]], axis=1)


def _gram_counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, context and symbol as one number, count): 9 bits a symbol, 256 marks the start."""
    found: dict[str, dict[int, int]] = {}
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            seq = np.concatenate([np.full(order, 256), np.frombuffer(raw, np.uint8)]).astype(np.int64)
            if len(raw):
                key = np.zeros(len(raw), np.int64)
                for k in range(order + 1):
                    key = key * 512 + seq[k : k + len(raw)]
                mine = found.setdefault(lang, {})
                for g, c in zip(*(x.tolist() for x in np.unique(key, return_counts=True)), strict=True):
                    mine[g] = mine.get(g, 0) + c
    for lang, mine in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], ["lang", "gram", "n"])


def learn(labelled: DataFrame, *, per_language: int = 300, order: int = 3, contexts: int = 3_000, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> PpmModel:
    """Trees from a bounded sample: about `per_language` documents of each language, those with the
    smallest hash of their id and text. Every language in the table is learned. A tree keeps contexts
    seen at least twice; of languages that share one the most frequent `contexts` for each stay."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("h")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("n") <= per_language, F.lit(2**62)).otherwise((F.lit(float(per_language) * 2**62) / F.col("n")).cast("long"))
    shares = rows.sparkSession.createDataFrame([(r["lang"], r["share"]) for r in sizes.select("lang", share.alias("share")).collect()], "lang string, share long")  # a row a language
    sample = rows.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned("h", 2) <= F.col("share")).select("lang", "text")
    grams = sample.mapInArrow(lambda b: _gram_counts(b, order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, int]] = {}
    for r in grams.toLocalIterator():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return build(counts, order, contexts)


def build(counts: dict[str, dict[int, int]], order: int, contexts: int) -> PpmModel:
    """The trees of languages in order, _TOGETHER to a tree, from counts of (order context symbols, symbol)."""
    known = sorted(la for la, c in counts.items() if c)
    groups = [known[k : k + _TOGETHER] for k in range(0, len(known), _TOGETHER)]
    return PpmModel([_tree({la: counts[la] for la in g}, order, contexts * len(g)) for g in groups])


def _tree(counts: dict[str, dict[int, int]], order: int, most_contexts: int) -> PpmTree:
    """The shared tree and its costs."""
    languages = sorted(la for la, c in counts.items() if c)
    used = np.zeros(256, bool)
    grams = {}
    for la in languages:
        g, n = (np.array(x, np.int64) for x in (list(counts[la]), list(counts[la].values())))
        sym = [(g >> (9 * (order - k))) & 511 for k in range(order + 1)]  # oldest first
        used[sym[-1]] = True
        grams[la] = (sym, n)
    known = np.flatnonzero(used)
    other, start = len(known), len(known) + 1  # symbol numbers: known bytes, any other byte, start of text
    symbol = np.full(256, other, np.int32)
    symbol[known] = np.arange(len(known))
    to_symbol = np.concatenate([symbol, np.full(256, start, np.int32)])
    # contexts by depth: path of symbols, nearest first
    tables: list[dict[tuple[int, ...], np.ndarray]] = []
    for la in languages:
        sym, n = grams[la]
        sym = [to_symbol[s] for s in sym]
        table: dict[tuple[int, ...], np.ndarray] = {}
        for depth in range(order + 1):
            key = np.zeros(len(n), np.int64)
            for k in range(1, depth + 1):
                key = key * 512 + sym[-1 - k]
            order_ = np.argsort(key, kind="stable")
            key, target, weight = key[order_], sym[-1][order_], n[order_]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for lo, hi in zip(edge, [*edge[1:], len(key)], strict=True):
                if depth == 0 or weight[lo:hi].sum() >= 2:
                    path = tuple(int(key[lo] >> (9 * (depth - 1 - k))) & 511 for k in range(depth))
                    table[path] = np.bincount(target[lo:hi], weight[lo:hi], minlength=start).astype(np.float64)
        tables.append(table)
    weight_of: dict[tuple[int, ...], float] = {}
    for table in tables:
        for path, c in table.items():
            weight_of[path] = weight_of.get(path, 0) + c.sum()
    chosen = sorted(weight_of, key=lambda p: (len(p) > 0, -weight_of[p], p))[: most_contexts + 1] or [()]
    chosen.sort(key=lambda p: (len(p), p))
    number = {(): 0}
    for path in chosen:
        if path and path[:-1] in number:
            number[path] = len(number)
    child = np.full((len(number), start + 1), -1, np.int32)
    cost = np.zeros((len(number), start + 1, max(1, len(languages))), np.float32)
    done: list[dict[tuple[int, ...], np.ndarray]] = [{} for _ in tables]
    for path, k in number.items():
        if path:
            child[number[path[:-1]], path[-1]] = k
        for j, table in enumerate(tables):
            own = path
            while own and own not in table:
                own = own[:-1]
            if own not in done[j]:
                done[j][own] = _costs(own, table, start)
            cost[k, :start, j] = done[j][own]
    return PpmTree(languages, symbol, child, cost, order)


def _costs(path: tuple[int, ...], table: dict[tuple[int, ...], np.ndarray], symbols: int) -> np.ndarray:
    """Bits of each symbol after this context, escapes and exclusions counted; the last symbol stands
    for any byte never seen."""
    out, escaped, excluded = np.full(symbols, np.inf), 0.0, np.zeros(symbols, bool)
    while True:
        c = np.where(excluded, 0, table[path]) if path in table else np.zeros(symbols)
        seen = c > 0
        n, q = c.sum(), seen.sum()
        if q:
            out[seen] = escaped - np.log2(c[seen] / (n + q))
            escaped -= np.log2(q / (n + q))
            excluded |= seen
        if not path:
            break
        path = path[:-1]
    left = 256 - excluded[:-1].sum()
    out[~excluded] = escaped + np.log2(max(1, left))
    return out


_OUT = "lang_pred string, score double, bits_per_byte double"


def identify(docs: DataFrame, model: PpmModel, *, text: str = "text", doc_id: str = "doc_id", whole: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every row's whole text.

    score is the posterior of the predicted language under equal priors, with the evidence of a text
    spread over at most 64 bytes' worth of code, so that long texts don't all score 1. A text that is
    null or has no letter (Unicode category L) is `und` with score 0, as is every text if nothing was
    learned; ties go to the language first in order. Repeated rows get one row each; an empty table gives
    none; a null doc_id stays null. With `whole` each row is
    (row: all its columns, lang_pred, score, bits_per_byte), so a filter needs no join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: PpmModel = shared.value
        languages = model.languages
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), _LETTER), False).to_numpy(zero_copy_only=False).copy()
            sizes = np.diff(offsets)
            if languages and len(sizes):
                bits = model.classify(raw, offsets)
                best = bits.argmin(1)
                least = bits[np.arange(len(best)), best]
                scaled = (bits - least[:, None]) * np.minimum(1, 64 / np.maximum(1, sizes))[:, None]
                score = 1 / np.exp2(-np.minimum(scaled, 500)).sum(1)
                rate = least / np.maximum(1, sizes)
            else:
                lettered[:], best, score, rate = False, np.zeros(len(sizes), int), np.zeros(len(sizes)), np.zeros(len(sizes))
            pred = [languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            made = [pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(rate.astype(np.float64))]
            yield carried(batch, whole, made, ["lang_pred", "score", "bits_per_byte"])

    return beside(docs, doc_id, text, mapped, _OUT, whole)
