"""The unigram language model: seed pieces, Viterbi, hard EM, pruning.

A model is a small table held by the driver (its size is the configured vocabulary); what runs over the
corpus is distributed. Segmentation runs in Arrow batches with the model broadcast; rounds of EM read a table
of lattices, in which the pieces at every place were looked up once.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..plans.tables import forget, written
from . import counts
from .lattice import CELLS, Lattice, Trie, best_pieces, blocks, costs
from .points import parts

#: What an unknown character costs, and the floor of a count (fixed values).
UNKNOWN_LP, FLOOR, LONGEST = -100.0, 1e-10, 16
#: Distinct sentences of at most this many characters in all are learned from in memory.
COMPACT_CHARS = 200_000


@dataclass
class Model:
    """Pieces in id order with log probabilities."""

    vocab: list[str]
    log_probs: list[float]

    @staticmethod
    def uniform(vocab: list[str]) -> Model:
        return Model(vocab, [-math.log(len(vocab))] * len(vocab) if vocab else [])

    def protected(self, k: int) -> bool:
        return len(self.vocab[k]) == 1 or self.vocab[k].startswith("<")

    def index(self) -> dict[str, float]:
        return dict(zip(self.vocab, self.log_probs, strict=True))


def closed(index: dict[str, float]) -> dict[str, float | None]:
    """The index with every prefix of its pieces beside them, as None: where a look-up fails, no longer
    piece can start."""
    out: dict[str, float | None] = {t[:k]: None for t in index for k in range(1, len(t))}
    out.update(index)
    return out


def spelled(text: str, index: dict[str, float | None]) -> tuple[list[str], float]:
    """Single characters, unknown ones at a fixed cost."""
    known = [index.get(c) for c in text]
    return list(text), math.fsum(UNKNOWN_LP if p is None else p for p in known)


def viterbi(text: str, index: dict[str, float | None], longest: int) -> tuple[list[str], float]:
    """Best pieces and their log probability; index as closed() gives it. Of equal scores the smallest
    start wins. Where the end can't be reached, single characters, unknown ones at a fixed cost."""
    n, none, get = len(text), -math.inf, index.get
    best, back = [0.0] + [none] * n, [0] * (n + 1)
    for start in range(n):
        base = best[start]
        if base == none:
            continue
        for end in range(start + 1, min(n, start + longest) + 1):
            lp = get(text[start:end], none)
            if lp is None:
                continue
            if lp == none:
                break
            if base + lp > best[end]:
                best[end], back[end] = base + lp, start
    if best[n] == none:
        return spelled(text, index)
    out, end = [], n
    while end:
        out.append(text[back[end] : end])
        end = back[end]
    return out[::-1], best[n]


def segmented(rows: DataFrame, model: Model, column: str) -> DataFrame:
    """rows with tokens and lp (of the best path through `column`) beside them; equal texts of a batch are
    segmented once."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    place = rows.columns.index(column)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        trie, cost, index = Trie(model.vocab), costs(model.log_probs), closed(model.index())
        names = pa.array(model.vocab, pa.string())
        for batch in batches:
            coded = batch.column(place).fill_null("").dictionary_encode()
            texts = coded.dictionary.to_pylist()
            done, owner, piece, score, apart = best_pieces(texts, trie, cost, lambda t: viterbi(t, index, trie.longest), lambda t: spelled(t, index))
            sizes = np.bincount(owner, minlength=len(done))
            joint = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), names.take(pa.array(piece)))
            both = pa.concat_arrays([joint, pa.array([t for t, _ in apart.values()], pa.list_(pa.string()))])
            at, lp = np.zeros(len(texts), np.int64), np.concatenate([score, [p for _, p in apart.values()]])
            at[done] = np.arange(len(done))
            at[list(apart)] = len(done) + np.arange(len(apart))
            take = at[np.asarray(coded.indices)]
            yield pa.RecordBatch.from_arrays([*batch.columns, both.take(pa.array(take)), pa.array(lp[take])], [*batch.schema.names, "tokens", "lp"])

    schema = StructType([*rows.schema.fields, StructField("tokens", ArrayType(StringType())), StructField("lp", DoubleType())])
    return rows.mapInArrow(mapped, schema)


def seed(marked: DataFrame, most: int) -> Model:
    """All characters in byte order, then the most frequent longer substrings up to `most` pieces in
    all, all equally likely. marked: (s, n)."""
    chars = sorted(r["ch"] for r in counts.character_counts(marked, "s").select("ch").collect())  # an alphabet
    top = counts.top_substrings(marked, "s", max(0, most - len(chars)), LONGEST)
    return Model.uniform([*chars, *(t for t, _ in top)])


def _sums(marked: DataFrame, model: Model) -> DataFrame:
    """(token, c, lp): pieces of the best paths through marked sentences (s, n), summed in each task, and the
    log probability of a task's sentences in a row without a token."""
    shared = marked.sparkSession.sparkContext.broadcast(model)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        trie, cost, index = Trie(model.vocab), costs(model.log_probs), closed(model.index())
        found, others, total = np.zeros(len(model.vocab)), Counter(), []
        for table in parts(batches):
            texts, weight = table["s"].to_pylist(), table["n"].to_numpy().astype(np.float64)
            done, owner, piece, score, apart = best_pieces(texts, trie, cost, lambda t: viterbi(t, index, trie.longest), lambda t: spelled(t, index))
            whole = np.array([k not in apart for k in done], bool)
            of = weight[np.array(done, np.int64)]
            found += np.bincount(piece, of[owner], len(found))
            total.append(float((score[whole] * of[whole]).sum()))
            for k, (tokens, lp) in apart.items():
                n = int(weight[k])
                for t in tokens:
                    others[t] += n
                total.append(lp * n)
        hit = np.flatnonzero(found)
        tokens, sums = [*(model.vocab[k] for k in hit.tolist()), *others], [*found[hit].astype(np.int64).tolist(), *others.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*tokens, None], pa.string()), pa.array([*sums, 0], pa.int64()), pa.array([0.0] * len(tokens) + [math.fsum(total)], pa.float64())], ["token", "c", "lp"])

    rows = marked.select("s", F.col("n").cast("long").alias("n"))
    return rows.mapInArrow(mapped, "token string, c long, lp double").groupBy("token").agg(F.sum("c").alias("c"), F.sum("lp").alias("lp"))


def token_sums(marked: DataFrame, model: Model) -> DataFrame:
    """(token, c): tokens of the best paths. marked: (s, n)."""
    return _sums(marked, model).where("token is not null").select("token", "c")


def expected(marked: DataFrame, model: Model) -> DataFrame:
    """(token, c): pieces of the best paths, known ones only. marked: (s, n)."""
    known = marked.sparkSession.createDataFrame([(t,) for t in model.vocab], "token string")
    return token_sums(marked, model).join(F.broadcast(known), "token", "left_semi")


def maximised(model: Model, found: dict[str, float]) -> Model:
    """Probabilities in proportion to the counts, each at least a floor."""
    total = sum(found.values()) + FLOOR * len(model.vocab)
    return Model(model.vocab, [math.log((found.get(t, 0.0) + FLOOR) / total) for t in model.vocab])


def log_likelihood(marked: DataFrame, model: Model) -> float:
    """Of the corpus, by best paths."""
    return _sums(marked, model).agg(F.sum("lp")).first()[0] or 0.0


def lattices(marked: DataFrame, model: Model) -> DataFrame:
    """A written table with a row for each sentence: n, its size, and the pieces at its places as bytes
    (places, lengths, numbers). What rounds of EM read: pieces are looked up once, and later models of fewer
    pieces only change what they cost. A sentence that fills a block alone keeps its text instead."""
    shared = marked.sparkSession.sparkContext.broadcast(model.vocab)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        room = CELLS // trie.longest
        for batch in batches:
            texts, weight = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            apart = [k for k, t in enumerate(texts) if len(t) >= room]
            none = pa.nulls(len(apart), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(weight[apart]), pa.array([len(texts[k]) for k in apart], pa.int32()), pa.array([texts[k] for k in apart], pa.string()), none, none, none], _LATTICE)
            for rows, _ in blocks([0 if len(t) >= room else len(t) for t in texts], trie.longest):
                rows = [k for k in rows if len(texts[k]) < room]
                lattice = Lattice.of([texts[k] for k in rows], trie)
                place, length, piece = lattice.edges()
                cut = np.searchsorted(place, [*lattice.first, len(lattice.cells)])
                local = place - np.repeat(lattice.first, np.diff(cut))
                cells = lambda v, kind: pa.array([v[a:b].astype(kind).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(weight[rows]), pa.array(lattice.size.astype(np.int32)), pa.nulls(len(rows), pa.string()), cells(local, "<u4"), cells(length, "u1"), cells(piece, "<u4")], _LATTICE)

    return written(marked.select("s", "n").mapInArrow(mapped, "n long, size int, s string, place binary, length binary, piece binary"))


_LATTICE = ["n", "size", "s", "place", "length", "piece"]


def counted(table: DataFrame, vocab: list[str], model: Model) -> dict[str, float]:
    """How often each piece of the model is on the best paths of lattices made for `vocab`, summed in each
    task first: at most the vocabulary reaches the driver."""
    number = {t: k for k, t in enumerate(vocab)}
    cost = np.full(len(vocab) + 1, -np.inf)
    cost[[number[t] for t in model.vocab]] = model.log_probs
    widest = max([len(t) for t in vocab], default=1)
    shared = table.sparkSession.sparkContext.broadcast((cost, widest, closed(model.index()), number))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, widest, index, number = shared.value
        found = np.zeros(len(cost))

        def one(text: str, n: float) -> None:
            for t in viterbi(text, index, widest)[0]:
                if t in number:
                    found[number[t]] += n

        for batch in batches:
            weight, sizes, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64), batch.column(2).to_pylist()
            for t, n in zip(texts, weight.tolist(), strict=True):
                if t is not None:
                    one(t, n)
            rows = [k for k, t in enumerate(texts) if t is None]
            for group, _ in blocks(sizes[rows].tolist(), widest):
                group = np.array(rows)[group]
                lattice = Lattice(sizes[group], widest, len(cost) - 1)
                pick = lambda c, kind: [np.frombuffer(x, kind) for x in batch.column(c).take(pa.array(group)).to_pylist()]  # noqa: B023, E731
                place, length, piece = pick(3, "<u4"), pick(4, "u1"), pick(5, "<u4")
                at = np.concatenate(place).astype(np.int64) + np.repeat(lattice.first, [len(x) for x in place])
                lattice.cells[at, widest - np.concatenate(length).astype(np.int64)] = np.concatenate(piece)
                owner, token, lost = lattice.tokens(*lattice.paths(cost))
                found += np.bincount(token, weight[group][owner], len(found))
                if lost.any():  # all characters are pieces in training, so every end is reached
                    raise ValueError("a sentence has characters that are no pieces")
        hit = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(found[hit])], ["piece", "c"])

    rows = table.mapInArrow(mapped, "piece long, c double").groupBy("piece").agg(F.sum("c").alias("c"))
    return {vocab[r["piece"]]: r["c"] for r in rows.collect()}


class Held:
    """The same for distinct sentences of bounded size, whose lattices stay in memory."""

    def __init__(self, rows: list[tuple[str, int]], vocab: list[str]):
        self.vocab, trie = vocab, Trie(vocab)
        self.parts = [(Lattice.of([rows[k][0] for k in group], trie), np.array([rows[k][1] for k in group], np.int64)) for group, alone in blocks([len(s) for s, _ in rows], trie.longest) if not alone]
        self.alone = [rows[k] for group, alone in blocks([len(s) for s, _ in rows], trie.longest) if alone for k in group]

    def counts(self, model: Model) -> dict[str, float]:
        """How often each piece of the model is on the best paths. All characters must be pieces."""
        number = {t: k for k, t in enumerate(self.vocab)}
        cost, found = np.full(len(number) + 1, -np.inf), np.zeros(len(number) + 1)
        cost[[number[t] for t in model.vocab]] = model.log_probs
        for lattice, weight in self.parts:
            owner, piece, _ = lattice.tokens(*lattice.paths(cost))
            found += np.bincount(piece, weight[owner], len(found))
        index, longest = closed(model.index()) if self.alone else {}, max([len(t) for t in model.vocab], default=1)
        for s, n in self.alone:
            for t in viterbi(s, index, longest)[0]:
                if t in number:
                    found[number[t]] += n
        return {self.vocab[k]: float(found[k]) for k in np.flatnonzero(found).tolist()}


def seed_of(rows: list[tuple[str, int]], most: int) -> Model:
    """seed(), of few rows."""
    found: Counter = Counter()
    for s, n in rows:
        for a in range(len(s)):
            for b in range(a + 1, min(len(s), a + LONGEST) + 1):
                found[s[a:b]] += n
    chars = sorted(t for t in found if len(t) == 1)
    extra = heapq.nsmallest(max(0, most - len(chars)), ((-c, t) for t, c in found.items() if len(t) > 1))
    return Model.uniform([*chars, *(t for _, t in extra)])


def em_step(marked: DataFrame, model: Model) -> tuple[Model, dict[str, float]]:
    """One round over a table (s, n)."""
    return measured_step(marked, model)[:2]


def measured_step(marked: DataFrame, model: Model) -> tuple[Model, dict[str, float], float]:
    """The same, with the log likelihood of the corpus before it, of one pass."""
    known, rows = {*model.vocab}, _sums(marked, model).collect()  # at most the vocabulary and an alphabet
    found = {r["token"]: float(r["c"]) for r in rows if r["token"] in known}
    return maximised(model, found), found, math.fsum(r["lp"] for r in rows)


def pruned(model: Model, found: dict[str, float], ratio: float) -> Model:
    """Without the pieces of smallest |count * log prob|: trunc(size * ratio) of them, as far as there
    are unprotected ones; of equal scores the smaller id goes first."""
    loose = [k for k in range(len(model.vocab)) if not model.protected(k)]
    loose.sort(key=lambda k: abs(found.get(model.vocab[k], 0.0) * model.log_probs[k]))
    gone = set(loose[: int(len(model.vocab) * ratio)])
    kept = [k for k in range(len(model.vocab)) if k not in gone]
    return Model([model.vocab[k] for k in kept], [model.log_probs[k] for k in kept])


def train(marked: DataFrame, target: int, factor: float, iterations: int, ratio: float, compact_chars: int = COMPACT_CHARS) -> tuple[Model, list[int]]:
    """EM and pruning until the target is reached or nothing can be removed, then EM once more. marked: (s, n)
    of distinct sentences. Lattices are built once, and again when half of their pieces are gone; of at most
    `compact_chars` characters, counted first, in memory. Also gives the vocabulary sizes on the way."""
    pieces = max(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")), marked.sparkSession.sparkContext.defaultParallelism)
    marked = written(marked.repartition(pieces))  # read several times
    small = (marked.agg(F.sum(F.length("s").cast("long"))).first()[0] or 0) <= compact_chars
    rows = [(r["s"], r["n"]) for r in marked.collect()] if small else []
    model = seed_of(rows, int(target * factor)) if small else seed(marked, int(target * factor))
    vocab, table = model.vocab, Held(rows, model.vocab) if small else lattices(marked, model)
    told = lambda model: table.counts(model) if small else counted(table, vocab, model)
    sizes = [len(vocab)]
    while len(model.vocab) > target:
        found: dict[str, float] = {}
        for _ in range(iterations):
            found = told(model)
            model = maximised(model, found)
        smaller = pruned(model, found, ratio)
        if len(smaller.vocab) == len(model.vocab):
            break
        model = smaller
        sizes.append(len(model.vocab))
        if 2 * len(model.vocab) < len(vocab) and not small:
            forget(table)
            vocab, table = model.vocab, lattices(marked, model)
    for _ in range(iterations):
        model = maximised(model, told(model))
    forget(marked, None if small else table)
    return model, sizes
