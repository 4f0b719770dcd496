"""Learning merge rules over a table, many merges a round.

Merges depend on each other, so one at a time would cost a job each. A round guesses the next ones instead.
Tasks apply the guess to their rows and say by how much each step changes each pair's count; sums of that
give the exact counts before every step, so the guess is checked after the fact: what one-at-a-time learning
would have taken as well counts, and the first step that differs names the right pair, which opens the next
guess. Rules never depend on how good a guess is; only the number of rounds does.

Pair counts (and how often each token occurs) are a table of deltas: counted once, then only the changes of
the steps that count are added. Within a task an index of the places of each pair makes a step touch nothing
but the places that hold its pair.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLOSE, CONTINUES, OPEN, tokens_of
from ..plans.tables import forget, written
from .merges import LinkedSegments, Segments, Start, pair_sums, token_sums
from .points import parts

#: Bytes of texts and of held segmentations that a task links at a time, and symbols of the sample that guesses come from.
TEXT, BLOCK, SAMPLE_SYMBOLS = 1 << 20, 3 << 20, 2_000_000
#: Merges guessed at least and at most, pairs brought to the driver, rules replayed before the table is rewritten.
FEWEST, MOST, HEAD, REPLAYED = 48, 128, 1500, 300
#: Rows brought to the driver to guess merges of rare pairs.
FETCHED = 20_000
_DELTA = "l string, r string, step int, d long"

Rule = tuple[str, str, str]


def _blocks(batches: Iterator[pa.RecordBatch], start: Start | None) -> Iterator[Segments]:
    """The segmentations of a task in blocks of bounded size: of texts that begin so, or of held ones."""
    for table in parts(batches, TEXT if start else BLOCK):
        yield start.segments(table["s"], table["n"], strict=True) if start else Segments.split(table["s"], table["n"])


def _first(state: DataFrame, start: Start | None, tokens: bool) -> DataFrame:
    """(l, r, step, d): how often each pair occurs, and with r null each token; summed by block."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, start):
            left, right, d = pair_sums(rows)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(d)], ["l", "r", "d"])
            if tokens:
                token, d = token_sums(rows.names, rows.ids, np.repeat(rows.weight, rows.size))
                yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.nulls(len(token), pa.string()), pa.array(d)], ["l", "r", "d"])

    found = state.select("s", "n").mapInArrow(mapped, "l string, r string, d long").groupBy("l", "r").agg(F.sum("d").alias("d"))
    return found.select("l", "r", F.lit(-1).alias("step"), "d")


def _merged(rows: LinkedSegments, rule: Rule) -> bool:
    """Apply a rule; False if a side never occurred."""
    a, b = rows.number.get(rule[0]), rows.number.get(rule[1])
    if a is None or b is None:
        return False
    rows.merge(a, b, rule[2])
    return True


def _changes(state: DataFrame, start: Start | None, replayed: list[Rule], guess: list[Rule]) -> DataFrame:
    """(l, r, step, d): what each step of the guess adds to each pair's count, and with r null to each
    token's. state: (s, n) before the rules replayed."""
    shared = state.sparkSession.sparkContext.broadcast((replayed, guess))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replayed, guess = shared.value
        for block in _blocks(batches, start):
            rows = LinkedSegments(block)
            for rule in replayed:
                _merged(rows, rule)
            rows.touched.clear()
            seen = dict(rows.count)
            out: list[tuple[str, str | None, int, int]] = []
            for step, rule in enumerate(guess):
                m = rows.number.get(rule[2], -1)
                before = rows.tokens.get(m, 0)
                if not _merged(rows, rule):
                    continue
                if moved := rows.tokens[rows.number[rule[2]]] - before:
                    out += [(rule[0], None, step, -moved), (rule[1], None, step, -moved), (rule[2], None, step, moved)]
                for code in rows.touched:
                    if d := rows.count[code] - seen.get(code, 0):
                        out.append((rows.names[code >> 32], rows.names[code & 0xFFFFFFFF], step, d))
                        seen[code] = rows.count[code]
                rows.touched.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["l", "r", "step", "d"])

    found = state.select("s", "n").mapInArrow(mapped, _DELTA)
    return found.groupBy("l", "r", "step").agg(F.sum("d").alias("d"))


def _rewritten(state: DataFrame, start: Start | None, rules: list[Rule]) -> DataFrame:
    """(s, n) after the rules."""
    shared = state.sparkSession.sparkContext.broadcast(rules)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, start):
            rows = LinkedSegments(block)
            for rule in shared.value:
                _merged(rows, rule)
            left = rows.symbol >= 0
            ends = np.cumsum(left)[np.cumsum(block.size) - 1]
            tokens = pa.array(rows.names, pa.string()).take(pa.array(rows.symbol[left]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), tokens)
            whole = pc.binary_join_element_wise(OPEN, pc.binary_join(lists, CLOSE + OPEN), CLOSE, "")
            yield pa.RecordBatch.from_arrays([whole, pa.array(block.weight)], ["s", "n"])

    return state.select("s", "n").mapInArrow(mapped, "s string, n long")


@dataclass
class Head:
    """The pairs that may be best at some step, in the order of their names, with exact counts before each
    step; `cut` is the key that all others come after, None if there are no others."""

    pairs: list[tuple[str, str]]
    counts: np.ndarray  # pairs by steps + 1
    tokens: dict[str, np.ndarray]  # how often each token occurs before each step
    cut: tuple[float, str, str] | None

    def values(self, step: int, least: int, by_score: bool) -> np.ndarray:
        """What pairs are compared by; -inf where they are too rare."""
        c = self.counts[:, step]
        value = c.astype(np.float64)
        if by_score:
            sides = [np.array([self.tokens[t][step] for t in side], np.float64) for side in zip(*self.pairs, strict=True)] if self.pairs else [value, value]
            value = c / np.maximum(sides[0] * sides[1], 1.0)
        return np.where(c >= max(1, least), value, -np.inf)


def _paths(path: Column) -> Column:
    return F.sort_array(F.collect_list(F.when(path >= 0, F.struct("step", "d"))))


def _head(deltas: list[DataFrame], steps: int, least: int, by_score: bool, most: int = HEAD) -> Head:
    """From tables of deltas; step -1 is what counts before the first step."""
    every = reduce(DataFrame.unionAll, deltas)
    start = F.coalesce(F.sum(F.when(F.col("step") < 0, F.col("d"))), F.lit(0)).alias("c")
    pairs = every.where("r is not null").groupBy("l", "r").agg(start, _paths(F.col("step")).alias("path"))
    peak = F.aggregate("path", F.struct(F.col("c").alias("now"), F.col("c").alias("top")), lambda a, x: F.struct((a["now"] + x["d"]).alias("now"), F.greatest(a["top"], a["now"] + x["d"]).alias("top")), lambda a: a["top"])
    rows = pairs.withColumn("peak", peak).where(F.col("peak") >= max(1, least))
    tokens: dict[str, np.ndarray] = {}

    def run(c: int, path: list) -> np.ndarray:
        out = np.zeros(steps + 1, np.int64)
        for x in path:
            out[x["step"] + 1] += x["d"]
        out[0] += c
        return np.cumsum(out)

    if by_score:  # at most as many tokens as the vocabulary has
        for r in every.where("r is null").groupBy("l").agg(start, _paths(F.col("step")).alias("path")).collect():
            tokens[r["l"]] = run(r["c"], r["path"])
        low = rows.sparkSession.createDataFrame([(t, int(max(1, x.min()))) for t, x in tokens.items()], "token string, low long")
        for side in ("l", "r"):
            rows = rows.join(F.broadcast(low.select(F.col("token").alias(side), F.col("low").alias(f"low_{side}"))), side)
        bound = F.col("peak").cast("double") / (F.col("low_l").cast("double") * F.col("low_r").cast("double"))
    else:
        bound = F.col("peak").cast("double")
    best = rows.select("l", "r", "c", "path", bound.alias("bound")).orderBy(F.desc("bound"), "l", "r").limit(most).collect()
    cut = (-best[-1]["bound"], best[-1]["l"], best[-1]["r"]) if len(best) == most else None
    best.sort(key=lambda r: (r["l"], r["r"]))
    table = np.array([run(r["c"], r["path"]) for r in best], np.int64).reshape(-1, steps + 1)
    return Head([(r["l"], r["r"]) for r in best], table, tokens, cut)


def _checked(head: Head, guess: list[Rule], least: int) -> tuple[list[tuple[str, str]], tuple[str, str] | None, bool]:
    """By score: the pairs of the guess that are right, the right pair after them (None if it can't be told), and
    whether no pair is left."""
    right: list[tuple[str, str]] = []
    for step in range(len(guess) + 1):
        value = head.values(step, least, True)
        k = int(value.argmax()) if len(value) else -1  # of equal ones the first name
        if k < 0 or value[k] == -np.inf:
            return right, None, head.cut is None
        pair = head.pairs[k]
        if head.cut is not None and (-value[k], *pair) > head.cut:
            return right, None, False
        if step == len(guess) or guess[step][:2] != pair:
            return right, pair, False
        right.append(pair)
    return right, None, False


def _commute(x: Rule, y: Rule) -> bool:
    """Whether two merges give the same tokens in either order: neither takes what the other takes or makes."""
    return not ({*x[:2]} & {*y} or {*y[:2]} & {*x}) and x[2] != y[2]


def _reordered(head: Head, guess: list[Rule], least: int) -> tuple[list[tuple[str, str]], tuple[str, str] | None, bool]:
    """As _checked, by frequency, for guesses that are right but for their order. A step may come early if it
    commutes with the steps it overtakes. The count of a pair follows only from the steps that share a token
    with it, so it is known exactly where those taken are the first of them; of other pairs, which have a
    token of an overtaken step and one of an early step, it is at most what the pairs they come from had.
    Steps count up to the last place where those taken are the first of the guess as a set."""
    index = {p: k for k, p in enumerate(head.pairs)}
    value = head.values(0, least, False)
    steps_of: dict[str, list[int]] = {}
    for k, rule in enumerate(guess):
        for t in {*rule}:
            steps_of.setdefault(t, []).append(k)
    with_token: dict[str, list[int]] = {}
    for p, k in index.items():
        for t in {*p}:
            if t in steps_of:
                with_token.setdefault(t, []).append(k)
    floor = float(max(least - 1, 0 if head.cut is None else -head.cut[0]))
    taken = [False] * len(guess)
    most: dict[tuple[str, str], float] = {}  # pairs whose count isn't known, and what it is at most
    order: list[tuple[str, str]] = []
    closed = 0

    def reach(p: tuple[str, str]) -> int | None:
        """After which step the count is what it is now; None if not after any."""
        steps = sorted({*steps_of.get(p[0], ()), *steps_of.get(p[1], ())})
        n = sum(taken[k] for k in steps)
        return None if any(not taken[k] for k in steps[:n]) else (steps[n - 1] + 1 if n else 0)

    def at_most(p: tuple[str, str]) -> float:
        return most[p] if p in most else max(least - 1.0, value[index[p]]) if p in index else floor

    while True:
        k = int(value.argmax()) if len(value) else -1
        if k < 0 or value[k] == -np.inf:
            return order[:closed], order[closed] if len(order) > closed else None, len(order) == closed and head.cut is None
        pair, doubt = head.pairs[k], max(most.values(), default=-1.0)
        if (head.cut is not None and (-value[k], *pair) > head.cut) or value[k] <= doubt:
            return order[:closed], order[closed] if len(order) > closed else None, False
        order.append(pair)
        step = next((n for n, rule in enumerate(guess) if not taken[n] and rule[:2] == pair), None)
        if step is None or not all(taken[n] or _commute(guess[n], guess[step]) for n in range(step)):
            return order[:closed], order[closed], False
        c, d, w = guess[step]
        fresh = {p: x + (at_most((d, p[1])) if p[0] == w else 0.0) + (at_most((p[0], c)) if p[1] == w else 0.0) for p, x in most.items()}
        for n in range(step):
            for u in {*guess[n]} if not taken[n] else ():
                fresh[u, w], fresh[w, u] = at_most((u, c)) + at_most((u, w)), at_most((d, u)) + at_most((w, u))
                for p in ((u, c), (u, d), (c, u), (d, u)):
                    fresh.setdefault(p, at_most(p))
        taken[step] = True
        most = {p: x for p, x in fresh.items() if reach(p) is None}
        for k in {i for t in {*guess[step]} for i in with_token.get(t, ())} | {index[p] for p in fresh if p in index}:
            after = reach(head.pairs[k])
            now = -np.inf if after is None else float(head.counts[k, after])
            value[k] = now if now >= max(1, least) else -np.inf
            if after is None:
                most.setdefault(head.pairs[k], float(head.counts[k].max()))
        if all(taken[: len(order)]):
            closed = len(order)


@dataclass
class BySample:
    """Guesses by frequency: a sample of rows is merged along. Pairs that the guess doesn't touch keep their
    exact counts; others change as they do in the sample."""

    rows: LinkedSegments
    scale: float
    least: int

    def take(self, rule: Rule) -> None:
        _merged(self.rows, rule)
        self.rows.touched.clear()

    def guess(self, head: Head, step: int, first: list[Rule], most: int, join: Callable[[str, str], str], *_) -> list[Rule]:
        rows, out = self.rows.copy(), []
        exact = {rows.intern(a) << 32 | rows.intern(b): int(c) for (a, b), c in zip(head.pairs, head.counts[:, step].tolist(), strict=True)}
        offset = {code: c - self.scale * rows.count.get(code, 0) for code, c in exact.items()}
        now: dict[int, float] = {}
        heap: list[tuple[float, str, str, int]] = []

        def told(code: int, value: float) -> None:
            now[code] = value
            if value >= max(1, self.least) - 0.5:
                heapq.heappush(heap, (-value, rows.names[code >> 32], rows.names[code & 0xFFFFFFFF], code))

        for code, c in exact.items():
            told(code, float(c))
        while len(out) < most:
            if len(out) < len(first):
                a, b = first[len(out)][:2]
            else:
                while heap and now.get(heap[0][3]) != -heap[0][0]:
                    heapq.heappop(heap)
                if not heap:
                    break
                _, a, b, _ = heapq.heappop(heap)
            out.append((a, b, join(a, b)))
            now.pop(rows.intern(a) << 32 | rows.intern(b), None)
            _merged(rows, out[-1])
            for code in rows.touched:
                if (code >> 32, code & 0xFFFFFFFF) != (rows.number[a], rows.number[b]):
                    told(code, offset.get(code, 0.0) + self.scale * rows.count[code])
            rows.touched.clear()
        return out


@dataclass
class ByRows:
    """Guesses by score: the best pairs are rare ones, so the rows that hold them are brought to the driver
    and merged along. Only they can change when such a pair is merged, so the guess is exact as far as the
    pairs it takes are among those, or come from them."""

    least: int

    def take(self, rule: Rule) -> None:
        pass

    def guess(self, head: Head, step: int, first: list[Rule], most: int, join: Callable[[str, str], str], state: DataFrame, start: Start | None, replayed: list[Rule]) -> list[Rule]:
        value = head.values(step, self.least, True)
        exact = {p: int(c) for p, c in zip(head.pairs, head.counts[:, step].tolist(), strict=True)}
        chosen, room = [r[:2] for r in first], FETCHED - sum(exact.get(r[:2], 0) for r in first)
        if room < 0:
            return first
        for k in np.argsort(-value, kind="stable")[:most].tolist():
            room -= exact[head.pairs[k]]
            if room < 0 or value[k] == -np.inf:
                break
            chosen.append(head.pairs[k])
        # a row that holds a pair holds its text, at the beginning if the left piece does
        text = F.replace(F.translate(F.col("s"), OPEN + CLOSE, ""), F.lit(CONTINUES), F.lit(""))
        plain = [(a.startswith(CONTINUES), a.replace(CONTINUES, "") + b.replace(CONTINUES, "")) for a, b in dict.fromkeys(chosen)]
        either = lambda inner: "|".join(re.escape(x) for later, x in plain if later == inner) or r"\b\B"
        holds = F.rlike(text, F.lit(f"^(?:{either(False)})|{either(True)}"))
        rows = LinkedSegments(_collected(state.where(holds).limit(FETCHED), start))
        for rule in replayed:
            _merged(rows, rule)
        rows.touched.clear()
        base, begun = dict(rows.count), dict(rows.tokens)
        token = {t: float(x[step]) for t, x in head.tokens.items()}
        marginal = lambda t: token.get(t, 0.0) + rows.tokens.get(rows.number.get(t, -1), 0) - begun.get(rows.number.get(t, -1), 0)
        now, heap, beside = dict(exact), [], {}
        fetched = {*chosen}

        def told(p: tuple[str, str]) -> None:
            for t in p:
                beside.setdefault(t, set()).add(p)
            if now[p] >= max(1, self.least) and (sides := marginal(p[0]) * marginal(p[1])) > 0:
                heapq.heappush(heap, (-now[p] / sides, *p))

        for p in exact:
            told(p)
        out: list[Rule] = []
        while len(out) < most:
            if len(out) < len(first):
                a, b = first[len(out)][:2]
            else:
                while heap and (now[heap[0][1:]] < max(1, self.least) or -heap[0][0] != now[heap[0][1:]] / max(marginal(heap[0][1]) * marginal(heap[0][2]), 1e-9)):
                    heapq.heappop(heap)
                if not heap or heap[0][1:] not in fetched:
                    break
                _, a, b = heapq.heappop(heap)
            out.append((a, b, join(a, b)))
            now[a, b] = 0
            if not _merged(rows, out[-1]):
                break
            moved = {(rows.names[code >> 32], rows.names[code & 0xFFFFFFFF]): rows.count[code] - base.get(code, 0) for code in rows.touched}
            for p, d in moved.items():
                if p != (a, b):
                    now[p] = exact.get(p, 0) + d
                    if out[-1][2] in p:
                        fetched.add(p)  # the new token stands nowhere else
            rows.touched.clear()
            for p in dict.fromkeys([*moved, *beside.get(a, ()), *beside.get(b, ())]):
                if p in now:
                    told(p)
        return out


def learn(state: DataFrame, *, by_score: bool, least: int, done: Callable[[int, int], bool], join: Callable[[str, str], str], seeds: list[str], most: int = MOST, head: int = HEAD, sample_symbols: int = SAMPLE_SYMBOLS, start: Start | None = None) -> list[Rule]:
    """Rules from a table (s: held segmentation, or a text that begins as `start` says; n) until `done(number of rules, size of vocabulary)` or no
    pair is left."""
    vocab, rules = set(seeds), []
    if done(0, len(vocab)):
        return rules
    spark = state.sparkSession
    # read in every round: a part a core at least, however small it is
    state = written(state.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    zero = F.lit(-1).alias("step")
    guesser = ByRows(least) if by_score else _sampled(state, start, least, sample_symbols)
    tables = [written(_first(state, start, by_score))]  # what the sums so far are made of
    known, replayed, guess, width = list(tables), [], [], FEWEST
    while True:
        fresh = written(_changes(state, start, replayed, guess)) if guess else None
        found = _head([*known, *([fresh] if guess else [])], len(guess), least, by_score, head)
        right, pending, over = _checked(found, guess, least) if by_score else _reordered(found, guess, least)
        for a, b in right:
            if not done(len(rules), len(vocab)):
                rules.append((a, b, join(a, b)))
                vocab.add(rules[-1][2])
                replayed.append(rules[-1])
                guesser.take(rules[-1])
        coming = (*pending, join(*pending)) if pending else None
        if coming and not done(len(rules), len(vocab)) and done(len(rules) + 1, len(vocab | {coming[2]})):
            rules.append(coming)
            over = True
        if over or done(len(rules), len(vocab)):
            forget(state, fresh, *tables)
            return rules
        if fresh is not None:
            tables.append(fresh)
            known.append(fresh.where(F.col("step") < len(right)).select("l", "r", zero, "d"))
        if guess and not right:  # too many pairs may be best at some step: fewer steps, more pairs
            width, head = 1, 2 * head
        elif guess:
            width = min(most, max(FEWEST, 2 * len(right)))
        if len(replayed) > REPLAYED:
            state, old = written(_rewritten(state, start, replayed)), state
            replayed, start = [], None
            forget(old)
        if len(known) > 6:
            every = reduce(DataFrame.unionAll, known)
            once = written(every.groupBy("l", "r").agg(F.sum("d").alias("d")).where("d <> 0").select("l", "r", zero, "d"))
            forget(*tables)
            tables, known = [once], [once]
        # without a pair known to be next, the counts alone tell it
        guess = guesser.guess(found, len(right), [coming], width, join, state, start, replayed) if coming else []


def _collected(rows: DataFrame, start: Start | None) -> Segments:
    """Of few rows of the table."""
    if start is None:
        return Segments.collected(rows.select(tokens_of("s").alias("tokens"), "n"))
    table = rows.select("s", "n").toArrow()
    return start.segments(table["s"], table["n"])


def _sampled(state: DataFrame, start: Start | None, least: int, symbols: int) -> BySample:
    """About so many symbols, of the rows with the smallest hash."""
    size = state.agg(F.sum((F.length("s") if start else F.size(tokens_of("s"))).cast("long"))).first()[0] or 0
    share = min(1.0, symbols / max(1, size))
    rows = state.where(F.shiftrightunsigned(F.xxhash64("s"), 2) <= int(share * (2**62 - 1)))
    sample = LinkedSegments(_collected(rows, start))
    sample.touched.clear()
    return BySample(sample, 1 / share, least)


def brute_force(rows: list[tuple[list[str], int]], *, by_score: bool, least: int, done: Callable[[int, int], bool], join: Callable[[str, str], str], seeds: list[str]) -> list[Rule]:
    """The same rules by counting all pairs anew before each merge; for tests."""
    state, vocab, rules = [(list(t), n) for t, n in rows], set(seeds), []
    while not done(len(rules), len(vocab)):
        pairs: dict[tuple[str, str], int] = {}
        tokens: dict[str, int] = {}
        for t, n in state:
            for x in t:
                tokens[x] = tokens.get(x, 0) + n
            for p in zip(t, t[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + n
        live = [(-c / (tokens[a] * tokens[b]) if by_score else -c, a, b) for (a, b), c in pairs.items() if c >= max(1, least)]
        if not live:
            break
        _, a, b = min(live)
        rules.append((a, b, join(a, b)))
        vocab.add(rules[-1][2])
        for t, _ in state:
            k = 0
            while k < len(t) - 1:
                if t[k] == a and t[k + 1] == b:
                    t[k : k + 2] = [rules[-1][2]]
                k += 1
    return rules
