"""What tasks sum before anything is shuffled: the same results, in blocks of bounded size."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import counts, guessed, merges, points, unigram
from lexweave.operators.models import Bpe, BpeConfig, SentenceBpe, SentenceBpeConfig, WordPiece, WordPieceConfig


@pytest.mark.parametrize("k", [1, 5, 40, 400])
def test_substrings_from_a_bad_sample(spark, monkeypatch, k):
    """A sample that says nothing costs passes, not results; texts longer than a block, and sums of one."""
    rng = random.Random(k)
    rows = [("".join(rng.choices("abcé▁😀", k=rng.randint(1, 40))), rng.randint(1, 4)) for _ in range(40)] + [("xyzw" * 6, 900), ("", 5)]
    want = Counter()
    for s, n in rows:
        for i in range(len(s)):
            for j in range(i + 2, min(len(s), i + 16) + 1):
                want[s[i:j]] += n
    want = sorted(want.items(), key=lambda x: (-x[1], x[0].encode()))[:k]
    table = spark.createDataFrame(rows, "s string, n long").repartition(3)
    for dense in (0, 1 << 22):
        monkeypatch.setattr(counts, "DENSE", dense)
        monkeypatch.setattr(counts, "SAMPLE_POINTS", 3)
        monkeypatch.setattr(counts, "HEAVY", 1)
        assert counts.top_substrings(table, "s", k) == want


def test_substrings_shuffle_sums_only(spark):
    """A text of 200,000 different places sends no more rows than there are nodes and letters."""
    rng = random.Random(0)
    text = "".join(rng.choices("abcdefgh", k=200_000))
    nodes = [*"abcdefgh", "ab", "cd"]
    out = list(counts._continued(nodes, 16)(iter([pa.RecordBatch.from_pydict({"s": [text], "n": [1]})])))
    assert sum(b.num_rows for b in out) <= len(nodes) * 9
    assert sum(b["c"].to_pylist()[0] for b in out) > 0


def test_blocks_are_cut_from_large_batches():
    texts = ["a" * n for n in (5, 100, 3, 0, 7, 250)] + [None, "é" * 30]
    got = list(points.parts(iter([pa.RecordBatch.from_pydict({"s": texts, "n": [1] * 8})]), 60))
    assert [x for t in got for x in t["s"].to_pylist()] == texts
    assert all(t.num_rows == 1 or sum(len((x or "").encode()) for x in t["s"].to_pylist()) <= 60 for t in got)
    codes, sizes = points.points(pa.array(["é😀", None, "", "a"]).slice(0))
    assert codes.tolist() == [233, 0x1F600, 97] and sizes.tolist() == [2, 0, 0, 1]
    assert points.points(pa.array(["xx", "b", "cd"]).slice(1))[0].tolist() == [98, 99, 100]


def test_first_characters(spark, monkeypatch):
    """Against all places: repeated and missing document numbers, white space of every kind, small blocks."""
    monkeypatch.setattr(points.parts, "__defaults__", (40,))
    rng = random.Random(4)
    docs = [(rng.choice([None, *range(25)]), "".join(rng.choices("abcdé😀 \n\t\r", k=rng.randint(0, 25)))) for _ in range(80)] + [(3, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    best = {}
    for d, text in docs:
        for w, word in enumerate(re.split(r"[ \t\n\x0b\f\r]+", text or "")):
            for p, c in enumerate(word):
                key = (d is not None, d or 0, w, p)
                best[c] = min(best.get(c, key), key)
    got = counts.first_characters(rows, "text", ["doc_id"], words=True).groupBy("token").agg(F.min(F.struct("row_no", "pos")).alias("at"))
    assert {r["token"]: (r["at"][0][0] is not None, r["at"][0][0] or 0, r["at"][0][1], r["at"][1]) for r in got.collect()} == best
    words = spark.createDataFrame([("ba", (2, 0)), ("ab", (1, 5)), ("cab", (1, 7)), ("b", (0, 1))], "word string, first struct<doc_id: long, place: int>")
    got = counts.first_seen_ids(counts.first_characters(words, "word", ["first.doc_id", "first.place"], pieces=True)).orderBy("token_id")
    assert [r["token"] for r in got.collect()] == ["b", "a", "##b", "c", "##a"]


def test_character_counts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(points.parts, "__defaults__", (10,))
    rows = [("abé", 2), ("", 9), ("😀a", 3), (None, 4), ("aa", 1)]
    got = counts.character_counts(spark.createDataFrame(rows, "s string, n long"), "s").collect()
    assert {r["ch"]: r["c"] for r in got} == {"a": 7, "b": 2, "é": 2, "😀": 3}


def test_frequencies_equal_replayed_columns(spark):
    rng = random.Random(2)
    words = spark.createDataFrame([("".join(rng.choices("abc#é", k=rng.randint(1, 12))), rng.randint(1, 5)) for _ in range(80)], "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    model = Bpe.train(words, BpeConfig(12, 2))
    want = counts.token_counts(model.segmented(words).select("tokens", "n"))
    assert {tuple(r) for r in model.frequencies(words).collect()} == {tuple(r) for r in want.collect()}
    lines = words.select(F.translate("word", "#", " ").alias("sentence"), "n").groupBy("sentence").agg(F.sum("n").alias("n")).where("trim(sentence) <> ''")
    model = SentenceBpe.train(lines, SentenceBpeConfig(12, 0.9, 2))
    want = counts.token_counts(model.segmented(lines).select("tokens", "n"))
    assert {tuple(r) for r in model.frequencies(lines).collect()} == {tuple(r) for r in want.collect()}
    with pytest.raises(Exception, match="U\\+0001"):
        Bpe([("a", "b", "ab")]).frequencies(spark.createDataFrame([("a\x02\x01b", 1)], "word string, n long")).collect()


def test_learning_from_texts_in_small_blocks(spark, monkeypatch):
    """Texts, held segmentations after a rewriting, and memory give the same rules."""
    monkeypatch.setattr(guessed, "REPLAYED", 3)
    monkeypatch.setattr(guessed, "TEXT", 50)
    monkeypatch.setattr(guessed, "BLOCK", 150)
    rng = random.Random(9)
    rows = [("".join(rng.choices("abcd", k=rng.randint(1, 14))), rng.randint(1, 6)) for _ in range(90)]
    words = spark.createDataFrame(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    assert Bpe.train(words, BpeConfig(20, 2)) == Bpe.train(words, BpeConfig(20, 2), compact_symbols=0, most=6)
    assert WordPiece.train(words, WordPieceConfig(30, 2)) == WordPiece.train(words, WordPieceConfig(30, 2), compact_symbols=0, most=6)
    lines = words.withColumnRenamed("word", "sentence")
    assert SentenceBpe.train(lines, SentenceBpeConfig(16, 0.8, 2)) == SentenceBpe.train(lines, SentenceBpeConfig(16, 0.8, 2), compact_symbols=0)


def test_sums_of_best_paths(spark):
    """Counts and likelihood of one pass, characters unknown included."""
    rng = random.Random(6)
    rows = list({"".join(rng.choices("abcdq▁", [5, 5, 5, 5, 1, 3], k=rng.randint(1, 30))): rng.randint(1, 5) for _ in range(120)}.items())
    model = unigram.Model(["a", "b", "c", "d", "▁", "ab", "cd", "▁a"], [-1.0, -1.25, -1.5, -1.75, -2.0, -1.5, -2.0, -1.25])
    want, total = Counter(), []
    for s, n in rows:
        tokens, lp = unigram.viterbi(s, unigram.closed(model.index()), 2)
        want.update({t: c * n for t, c in Counter(tokens).items()})
        total.append(lp * n)
    marked = spark.createDataFrame(rows, "s string, n long").repartition(3)
    assert {r["token"]: r["c"] for r in unigram.token_sums(marked, model).collect()} == want
    _, found, lp = unigram.measured_step(marked, model)
    assert found == {t: c for t, c in want.items() if t != "q"}
    assert math.isclose(lp, math.fsum(total)) and math.isclose(unigram.log_likelihood(marked, model), lp)


def test_white_space_and_marks(spark):
    rows = spark.createDataFrame([(chr(c) + " a\t b " + chr(c),) for c in range(1, 0x3002)] + [("",), (" \t",)], "v string")
    old = F.regexp_replace("v", r"(?U)^\s+|\s+$", "")
    assert rows.where(T.trimmed("v") != old).count() == 0
    old = F.array_join(F.transform(F.filter(F.split("v", "[ \t]+"), lambda x: x != ""), lambda x: F.concat(F.lit("▁"), x)), "")
    assert rows.where(T.marked_sentence("v") != old).count() == 0
