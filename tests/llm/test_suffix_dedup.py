"""Suffix dedup against a dictionary of all strings."""

import random

import numpy as np
import pytest

from lexweave.llm import suffix_dedup as sd


def texts(seed, n=60, alphabet="ab"):
    rng = random.Random(seed)
    pool = ["".join(rng.choices(alphabet, k=rng.randint(60, 400))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 1)
            t += p[a : rng.randint(a, len(p))] + rng.choice(["", "x", "éß", "".join(rng.choices(alphabet, k=30))])
        out.append(t)
    return out


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "ab"), (2, "abcdefgh"), (3, "a")])
def test_against_brute_force(spark, seed, alphabet):
    rows = list(enumerate(texts(seed, alphabet=alphabet), -5))
    rows += [(500, "ab" * 400), (501, "a" * 1500), (502, "a" * 99), (503, "a" * 100), (504, rows[0][1] * 3), (505, "\0" * 300 + "q"), (506, "\0" * 150)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string").repartition(3)
    want = sd.brute_force([(d, t.encode()) for d, t in rows])
    for local in (2 << 20, 700):
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in sd.remove_repeats(docs, local_bytes=local, block_bytes=2000).collect()}
        assert got == want


def test_edges(spark):
    long = "".join(random.Random(5).choices("abcdefghij klm", k=500))
    rows = [(1, None), (2, ""), (7, long), (7, long), (None, long), (9, "z" + long)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (7, 500, 0), (7, 500, 0), (None, 500, 500), (9, 501, 500)], key=str)
    assert sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").where("false")).count() == 0


def test_rows_that_share_an_id(spark):
    """A string that another document has earlier leaves every row of the id, whatever follows it there."""
    q = "".join(chr(0x21 + k) for k in np.random.default_rng(7).integers(0, 90, 400))
    rows = [(1, "zz" + q[:150]), (5, q + "1"), (5, q + "2")]
    for local in (1 << 20, 300):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), local_bytes=local).collect())
        assert got == [(1, 152, 0), (5, 401, 150), (5, 401, 150)]


def test_hot_passage_and_hot_rows(spark):
    """One passage in every document, with ends that differ, overfills a block under one anchor; one row
    that stands many times keeps its place."""
    rng = random.Random(11)
    shared = "".join(rng.choices("abcdefgh ", k=260))
    rows = [(d, "".join(rng.choices("klmnop", k=rng.randint(30, 90))) + shared + "".join(rng.choices("qrstuv", k=50))) for d in range(120)]
    want = sd.brute_force([(d, t.encode()) for d, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (1 << 20, 4000, 200):
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in sd.remove_repeats(docs, block_bytes=block, local_bytes=900, bucket_bytes=2000).collect()}
        assert got == want
    same = spark.createDataFrame([(3, shared)] * 500 + [(9, shared)], "doc_id long, text string").repartition(7)
    got = {(r.doc_id, r.n_removed) for r in sd.remove_repeats(same, local_bytes=2000).collect()}
    assert got == {(3, 0), (9, 260)}


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sd.brute_force([(r.doc_id, r.text.encode()) for r in docs.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in sd.remove_repeats(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_cover_and_block_order():
    for v in (7, 32, 64):
        cover = set(sd.difference_cover(v).tolist())
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    body = np.frombuffer(("abcab" * 60 + "x" + "abcab" * 50 + "q" * 200).encode(), np.uint8)
    block, at = sd.Block(body), np.arange(0, len(body) - 100)
    order = block.order(at)
    keys = [bytes(body[i : i + 100]) for i in at[order].tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == at.tolist()
