"""Decontamination and SimHash against brute force."""

import random

import numpy as np
import pytest

from lexweave.llm import decontaminate as dc
from lexweave.llm import simhash as sh

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, words string, fp string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], DOCS)


def test_decontaminate_edges(spark):
    words = [f"w{k}" for k in range(30)]
    bench = [(1, " ".join(words[:12])), (2, "Short ITEM"), (3, None), (4, "..."), (None, "w1 w2"), (1, " ".join(words[:12])), (5, " ".join(words[1:11]))]
    rows = [(1, "x " + ", ".join(words[:11]) + " é short item"), (2, None), (3, ""), (4, "SHORT--item short item"), (4, "nothing"), (5, " ".join(words) * 3), (6, "shorté item")]
    docs, items = frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    want = [dc.brute_force([r], [b for b in bench if b[0] is not None])[r[0]] for r in rows]
    for slice_chars in (4_000_000, 60):
        got = dc.digest_of(dc.decontaminate(docs, items, slice_chars=slice_chars)).collect()
        assert sorted(map(tuple, got)) == sorted((d, *w) for (d, _), w in zip(rows, want, strict=True))
    for chars in (4_000_000, 60):  # whole rows, ids of none and columns that clash among them
        odd = spark.createDataFrame([(d, t, 1, 2, "w", "i") for d, t in [*rows, (None, "short item"), (None, None)]], "doc_id long, text string, __row long, __all long, words string, items string")
        whole = dc.decontaminate(odd, items, slice_chars=chars, whole=True)
        assert whole.select("row.*").columns == odd.columns
        told = sorted(((r.row.doc_id, r.row.text, len(r["items"])) for r in whole.collect()), key=str)
        assert told == sorted([(d, t, w[2]) for (d, t), w in zip(rows, want, strict=True)] + [(None, "short item", 1), (None, None, 0)], key=str)
        both = dc.decontaminate(docs, items, slice_chars=chars).where("doc_id = 1").collect()[0]
        assert [rows[0][1][s.first : s.last] for s in both.spans] == [", ".join(words[:11]), "short item"]
    spans = dc.decontaminate(docs, items).where("doc_id = 4 and size(spans) > 0").first().spans
    assert [(s.first, s.last) for s in spans] == [(0, 22)]
    assert dc.digest_of(dc.decontaminate(docs, items.where("false"))).where("contaminated").count() == 0
    assert dc.decontaminate(docs.where("false"), items).count() == 0


def test_decontaminate_table(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = dc.brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {r[0]: tuple(r[1:]) for r in dc.digest_of(dc.decontaminate(docs, items)).collect()}
    assert got == want
    assert any(w[4] for w in want.values())


def test_simhash_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sh.brute_force({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (int.from_bytes(r.fp, "big"), r.component_id) for r in sh.near_groups(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_simhash_edges(spark):
    rows = [(5, None), (3, " \t"), (9, ""), (7, "one two"), (8, "ONE\ntwo"), (None, "one two"), (7, "one two"), (11, "a b c d e f g")]
    got = sorted(((r.doc_id, r.component_id) for r in sh.near_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (8, 7), (None, 7), (7, 7), (11, 11)], key=str)
    assert sh.near_groups(frame(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize(("seed", "lanes"), [(1, 1), (2, 1), (3, 4)])
def test_gray_index_is_exact(seed, lanes):
    rng, bits, distance = random.Random(seed), 64 * lanes, 4 if lanes == 1 else 40
    centres = [rng.getrandbits(bits) for _ in range(40)]
    made = sorted({c ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(0, distance + 1))) for c in centres for _ in range(25)})
    fps = np.frombuffer(b"".join(f.to_bytes(8 * lanes, "big") for f in made), ">u8").astype(np.uint64).reshape(-1, lanes)
    got = {tuple(sorted(p)) for a, b in sh.GrayIndex(fps).links(distance) for p in zip(a.tolist(), b.tolist(), strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(2) <= distance
    want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    assert got == want
    forest = sh._Forest(len(made))
    for a, b in sh.GrayIndex(fps).links(distance, forest):
        forest.join(a, b)
    full = sh._Forest(len(made))
    full.join(*(np.array(x) for x in zip(*sorted(want), strict=True)))
    assert (forest.roots() == full.roots()).all()
    order = sorted(range(len(made)), key=lambda k: tuple(sh.gray_rank(fps[k : k + 1])[0].tolist()))
    assert order == sorted(range(len(made)), key=lambda k: _rank(made[k])) and _rank(made[0]) ^ (_rank(made[0]) >> 1) == made[0]


def _rank(x):
    out = 0
    while x:
        out ^= x
        x >>= 1
    return out


@pytest.mark.parametrize("n", [100, 10**6, 10**9, 10**11])
def test_exact_tables_bring_all_within_the_distance_together(n):
    tables, rng = sh.NARROW.tables(n), random.Random(5)
    assert n / 2 ** len(tables[0]) <= 2 * sh._BUCKET or len(tables) == 70
    for _ in range(300):
        changed = set(rng.sample(range(64), 4))
        assert any(not changed & set(t.tolist()) for t in tables)


def test_wide_tables_keep_their_promise():
    rng = np.random.default_rng(3)
    tables = sh.WIDE.tables(10**6)
    met = [any(not changed[t].any() for t in tables) for changed in (np.isin(np.arange(256), rng.choice(256, 40, replace=False)) for _ in range(4000))]
    assert np.mean(met) > 0.9 - 3 * (0.9 * 0.1 / 4000) ** 0.5


def test_wide_groups(spark):
    """Copies with a few words changed are one group; each row has its place, whatever its id."""
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(900)]
    rows = []
    for k in range(60):
        base = rng.choices(vocab, k=300)
        rows.append((1000 - k, " ".join(base)))
        if k < 30:
            base[rng.randint(0, 299)] = "other"
            rows.append((k, " ".join(base)))
    rows += [(None, None), (None, ""), (5000, "tail"), (5000, "tail"), (5001, "tail"), (7, "seven")]
    docs = frame(spark, rows).repartition(3)
    path = sh.written(docs)
    kept = sh.one_of_each(path)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert sorted(str(d) for d, _ in got) == sorted(["None", "5000", "7", *map(str, range(30)), *(str(1000 - k) for k in range(30, 60))])
    assert sh.one_of_each(path.where("false")).count() == 0
    texts = {k: t for k, (_, t) in enumerate(rows[:40])}
    want = sh.brute_force(texts, sh.WIDE)
    found = {r.doc_id: (int.from_bytes(r.fp, "big"), r.component_id) for r in sh.near_groups(frame(spark, list(texts.items())), sh.WIDE).collect()}
    assert found == want


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (1002, 1001)], "a long, b long")
    got = {r.v: r.root for r in sh.components(edges).collect()}
    assert got == {k: 0 for k in range(1, n + 1)} | {1001: 1000, 1002: 1000}
