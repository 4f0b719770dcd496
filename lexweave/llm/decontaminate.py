"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

A-Z is lower-cased; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Every window of ten consecutive
item words (a shorter item: the whole item) becomes one pattern, words joined and framed by single
spaces. Each text is normalised the same way and scanned once; matches are turned into word numbers,
and word numbers into code-point offsets of the original text.

Windows are cut and made distinct by the tasks. The automaton is built once and sent to them; it holds at
most `slice_chars` pattern characters. A benchmark of more is dealt by hash into several slices of that
size, each a pass of its own over the texts, of which only hits are kept: neither the driver nor a task
ever holds two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, carried, texts_of, written

#: Word bytes stay, A-Z is lower-cased, all else is a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def windows_of(raw: bytes, n: int) -> set[bytes]:
    words = words_of(raw)
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def windows(benchmark: DataFrame, n: int, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(pattern, items) of every distinct window, items sorted."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                if found := sorted(windows_of(raw, n)):
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], ["pattern", "item"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    return rows.mapInArrow(mapped, "pattern binary, item string").groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code-point start and end of each word in the original text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    folded = np.where(codes < 128, np.frombuffer(_FOLD, np.uint8)[np.minimum(codes, 127)], 255)
    edge = np.diff(np.concatenate([[0], (folded != 32).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def automaton_of(patterns: list[tuple[bytes, list[str]]]):
    """The automaton, each pattern's value its length and its items."""
    import ahocorasick

    built = ahocorasick.Automaton()
    for pattern, items in patterns:
        built.add_word(f" {pattern.decode('latin-1')} ", (len(pattern) + 2, items))
    if patterns:
        built.make_automaton()
    return built


def scan(raw: bytes, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged ranges of hit words (end exclusive), items with occurring windows."""
    words = words_of(raw)
    if not words or not len(automaton):
        return len(words), [], set()
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    found = list(automaton.iter(line))
    if not found:
        return len(words), [], set()
    begins = np.cumsum([0, *(len(w) + 1 for w in words)])  # of the space before each word
    ends = np.array([e for e, _ in found])
    starts = ends - np.array([size for _, (size, _) in found]) + 1
    first, last = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
    spans: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist(), strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return len(words), spans, {item for _, (_, items) in found for item in items}


_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_OUT = "n_words long, words array<struct<first:int,last:int>>, spans array<struct<first:int,last:int>>, items array<string>"


def _pass(docs: DataFrame, patterns: DataFrame, text: str, doc_id: str, whole: bool) -> DataFrame:
    """docs judged by one slice's patterns, which the driver turns into the automaton."""
    built = automaton_of([(bytes(r["pattern"]), r["items"]) for r in patterns.toLocalIterator()])
    shared = docs.sparkSession.sparkContext.broadcast(built)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            n_words, words, spans, items = [], [], [], []
            for raw in texts_of(batch.column(1)):
                n, hit, names = scan(raw, automaton)
                at = word_spans(raw.decode("utf-8", "replace")) if hit else []
                n_words.append(n)
                words.append([{"first": a, "last": b} for a, b in hit])
                spans.append([{"first": at[a][0], "last": at[b - 1][1]} for a, b in hit])
                items.append(sorted(names))
            made = [pa.array(n_words, pa.int64()), pa.array(words, _SPAN), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))]
            yield carried(batch, whole, made, ["n_words", "words", "spans", "items"])

    return beside(docs, doc_id, text, mapped, _OUT, whole)


def _merged(pairs: Column) -> Column:
    """Ranges (w: words, s: code points) in order, those that touch or overlap as one."""
    start = F.array().cast("array<struct<w:struct<first:int,last:int>,s:struct<first:int,last:int>>>")
    range_of = lambda a, b: F.struct(a["first"].alias("first"), F.greatest(a["last"], b["last"]).alias("last"))

    def step(a: Column, x: Column) -> Column:
        top = F.element_at(a, -1)
        one = F.struct(range_of(top["w"], x["w"]).alias("w"), range_of(top["s"], x["s"]).alias("s"))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["w"]["last"] >= x["w"]["first"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(one))).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(pairs), start, step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", slice_chars: int = 4_000_000, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, words (merged ranges of hit words), spans (the same as
    code-point offsets of the original text, end exclusive), items (sorted ids, as strings).

    A null text has no words; items without words and null item ids have no windows. Items that share
    a window are all named. Repeated documents are judged one by one, repeated items count once; a null
    doc_id stays null. With an empty benchmark nothing is hit. Other columns are ignored; with `whole`
    each row has the struct `row` of all its columns in doc_id's place, so a filter needs no join.
    """
    found = written(windows(benchmark, window, text, item_id))
    chars = found.agg(F.sum(F.octet_length("pattern").cast("long") + 2)).first()[0] or 0
    slices = max(1, -(-chars // slice_chars))
    if slices == 1:
        return _pass(docs, found, text, doc_id, whole)
    rows = written(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all")))
    narrow = rows.select("__row", F.col(f"__all.`{text}`").alias("text"))
    hits, sizes = None, None
    for k in range(slices):
        told = written(_pass(narrow, found.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == k), "text", "__row", False).where(F.lit(k == 0) | (F.size("items") > 0)).withColumnRenamed("doc_id", "__row"))
        sizes = told.select("__row", "n_words") if k == 0 else sizes
        hit = told.where(F.size("items") > 0).select("__row", F.zip_with("words", "spans", lambda w, s: F.struct(w.alias("w"), s.alias("s"))).alias("pairs"), "items")
        hits = hit if hits is None else hits.union(hit)
    one = hits.groupBy("__row").agg(_merged(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.join(sizes, "__row").join(one, "__row", "left")
    part = lambda k: F.coalesce(F.transform("pairs", lambda p: p[k]), F.array().cast("array<struct<first:int,last:int>>")).alias("words" if k == "w" else "spans")
    own = F.col("__all").alias("row") if whole else F.col(f"__all.`{doc_id}`").cast("long").alias("doc_id")
    return joined.select(own, "n_words", part("w"), part("s"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest_of(found: DataFrame) -> DataFrame:
    """The counts and the digest of the items, per document."""
    hits = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + (w["last"] - w["first"]).cast("long"))
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = 10) -> dict[int, tuple]:
    """The same counts by comparing every window with every place; for tests."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            for k in range(max(1, len(iw) - window + 1)) if iw else []:
                piece = iw[k : k + window]
                for p in range(len(w) - len(piece) + 1):
                    if w[p : p + len(piece)] == piece:
                        hit |= set(range(p, p + len(piece)))
                        names.add(str(item))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out
