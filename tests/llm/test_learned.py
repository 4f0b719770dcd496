"""Toxicity, clustering and resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import clustering, resampling, toxicity
from lexweave.llm import queries as q
from lexweave.llm.common import text_buffers
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- toxicity


@pytest.mark.parametrize("span", [1 << 20, 64])
def test_terms_are_words(monkeypatch, span):
    monkeypatch.setattr(toxicity, "SPAN", span)
    monkeypatch.setattr(toxicity, "_tables", [])
    texts = ["One two, ONE. two-three\n", "", "éa Éa 7x", "...", "z" * 50 + " a b " * 40, "tail"]
    idx, count, at = toxicity.hashed_terms(*text_buffers(pa.array([*texts, None])), 1 << 40)
    assert len(at) == len(texts) + 2
    for text, a, b in zip(texts, at, at[1:], strict=False):
        assert sorted(count[a:b].tolist()) == sorted(Counter(words(text)).values())
    again, _, at = toxicity.hashed_terms(*text_buffers(pa.array(["two one three"])), 1 << 40)
    assert set(idx[: at[1]].tolist()) == set(again.tolist())


def test_long_text_in_spans():
    text = " ".join(f"w{k % 5000}" for k in range(400_000))  # over two spans
    idx, count, at = toxicity.hashed_terms(*text_buffers(pa.array(["w1 w2", text])), 1 << 40)
    assert at.tolist() == [0, 2, 5002] and set(count[2:].tolist()) == {80}


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(0.3, rng.normal(size=4), rng.normal(size=(4, 3)), np.array([-1, 0, 1, 2, 3]))
    idx, count, at = np.array([0, 1, 3, 4]), np.array([5, 1, 2, 7]), np.array([0, 4])
    x = {0: 1.0, 2: 1 + math.log(2), 3: 1 + math.log(7)}
    pairs = sum(x[i] * x[j] * float(m.factors[i] @ m.factors[j]) for i in x for j in x if i < j)
    assert math.isclose(m.margin(idx, count, at)[0], 0.3 + sum(m.linear[i] * x[i] for i in x) + pairs)


def labelled(n, seed):
    """Toxic where an insult and a mention stand together; each alone is as common in clean texts."""
    rng, out = random.Random(seed), []
    for k in range(n):
        body = [f"common{rng.randrange(30)}" for _ in range(rng.randrange(5, 30))]
        kind = rng.randrange(4)
        body += [f"insult{rng.randrange(3)}"] * (kind & 1) + [f"group{rng.randrange(3)}"] * (kind >> 1)
        rng.shuffle(body)
        out.append((k, " ".join(body), int(kind == 3)))
    return out


def test_pairs_decide(spark):
    rows = labelled(1500, 1)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    machine = toxicity.learn(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    fresh = labelled(600, 2)
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame([(d, t) for d, t, _ in fresh], "doc_id long, text string"), machine).collect()}
    right = sum((got[d]["score"] >= 0.5) == bool(y) for d, _, y in fresh)
    assert right >= 0.97 * len(fresh)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_toxicity_of_odd_rows(spark):
    rows = labelled(400, 5)
    odd = [(None, "x insult1 group1"), (1, None), (2, ""), (2, ""), (3, " \n"), (4, "common1 " * 300_000), (5, "insult1 group1"), (5, "insult1 group1")]
    docs = spark.createDataFrame([(d, t, 1.0, "a", 1) for d, t in [*odd, *[(d + 10, t) for d, t, _ in rows]]], "doc_id long, text string, score double, bucket string, label int")
    labels = spark.createDataFrame([*[(d + 10, y) for d, _, y in rows], (None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels)
    got = toxicity.score(docs.repartition(3), machine).collect()
    assert len(got) == len(odd) + len(rows) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    assert toxicity.score(docs.where("false"), machine).count() == 0
    none = toxicity.learn(docs.where("false"), labels)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    one = toxicity.learn(docs, labels.where("toxic = 0"))
    assert all(r["predicted"] == 0 for r in toxicity.score(docs, one).collect())
    few = toxicity.learn(docs, labels, most_rows=50)
    assert toxicity.score(docs, few).count() == len(got)


def test_held_out_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in q.op11_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in marks]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    hits = Counter((marks[r["doc_id"]], r["predicted"]) for r in got)
    assert hits[1, 1] >= 0.8 * (hits[1, 0] + hits[1, 1])
    assert hits[0, 1] <= 0.005 * (hits[0, 0] + hits[0, 1])
    assert docs.count() == 10_000


# --- clustering


def lloyd(rows, k, rounds):
    """(vec_id, cluster, distance) and centroids, all over in every round."""
    kept = [(d, [math.floor(256 * x) for x in v]) for d, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]
    told = []
    for r in range(rounds + 1):
        told = [(d, v, *min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))) for d, v in kept]
        if r < rounds:
            for n in range(len(at)):
                mine = [v for _, v, _, c in told if c == n]
                if mine:
                    at[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(d, c, gap) for d, _, gap, c in told], at


def vectors(seed, n=150, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.uniform(-spread, spread) for _ in range(64)] for _ in range(6)]
    rows = [(k, [x + rng.gauss(0, 0.2 * spread) for x in rng.choice(middles)]) for k in range(n)]
    return rows + [(900 + k, rows[0][1]) for k in range(60)] + [(rows[1][0], rows[2][1]), (None, rows[3][1])]


@pytest.mark.parametrize(("k", "rounds", "spread"), [(8, 5, 1.0), (3, 0, 1.0), (40, 5, 0.004), (5, 5, 200_000.0)])
def test_clusters_by_hand(spark, k, rounds, spread):
    rows = vectors(k, spread=spread)
    bad = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 63 + [None]), (1004, [float("nan")] * 64), (1005, [float("-inf")] * 64)]
    table = spark.createDataFrame([(d, v, 7, 1.0, 2) for d, v in [*rows, *bad]], "vec_id long, embedding array<double>, cluster int, distance double, v int").repartition(3)
    found, centroids = clustering.cluster(table, k=k, rounds=rounds)
    told = clustering.with_inertia(found, centroids).collect()
    want, at = lloyd(rows, k, rounds)
    assert centroids.at.tolist() == at
    inertia, total = Counter(), sum(g for _, _, g in want)
    for _, c, g in want:
        inertia[c] += g
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    assert sorted(map(str, map(tuple, told))) == sorted(str((d, c, g, inertia[c], total, hashes[c])) for d, c, g in want)


def test_clusters_of_few_and_none(spark):
    table = spark.createDataFrame([(d, v) for d, v in vectors(1, n=4)[:3]], "vec_id long, embedding array<float>")
    assert sorted(r["distance"] for r in clustering.cluster(table)[0].collect()) == [0, 0, 0]
    for none in (table.where("false"), table.where("vec_id = 0").selectExpr("vec_id", "slice(embedding, 1, 5) AS embedding")):
        assert clustering.with_inertia(*clustering.cluster(none)).count() == 0
    with pytest.raises(Exception, match="components must be under"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_only_what_moved_is_compared():
    rng = np.random.default_rng(1)
    v, at = rng.integers(-3, 4, (500, 64)), rng.integers(-3, 4, (9, 64))
    every = np.ones(9, bool)
    owner, gap = clustering.nearest(v, np.full(500, -1), np.zeros(500, np.int64), at, every)
    later = at.copy()
    later[[2, 5]] = rng.integers(-3, 4, (2, 64))
    got = clustering.nearest(v, owner, gap, later, (later != at).any(1))
    want = clustering.nearest(v, np.full(500, -1), np.zeros(500, np.int64), later, every)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    big = v * (1 << 22)
    assert (clustering.distances(big, big[:7]) == ((big[:, None] - big[None, :7]) ** 2).sum(2)).all()


# --- resampling


def resampled(rows, target, longest=2, buckets=10_000, share=25, least=20, salt="7:"):
    def features(text):
        w = words(text)
        return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)), len(w)

    each = [(d, *features(t)) for d, t in rows]
    s, t = sum((f for _, f, _ in each), Counter()), sum((features(x)[0] for x in target), Counter())
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out = []
    for d, f, n in each:
        weight = sum(gain[b] * c for b, c in f.items()) // max(1, sum(f.values()))
        h = int(hashlib.sha256(f"{salt}{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(drawn[: len(drawn) * share // 100]):
        r[5] = k + 1
    return sorted(map(str, map(tuple, out)))


@pytest.mark.parametrize(("longest", "buckets"), [(2, 10_000), (1, 64), (3, 65_536)])
def test_resampling_by_hand(spark, longest, buckets):
    rng = random.Random(longest)
    pool = [f"w{k}" for k in range(80)] + ["É", "éa", "A1"]
    body = lambda n: " ".join(rng.choice(pool) + rng.choice(["", ".", "-x", "\n"]) for _ in range(n))
    rows = [(k, body(rng.randrange(0, 60))) for k in range(120)] + [(500 + k, "the same words over and over " * 6) for k in range(60)]
    rows += [(None, None), (None, body(30)), (7, None), (8, ""), (9, " .,"), (10, "Q" * 700), (11, body(900)), (12, "two words")]
    target = [body(40), None, "", body(3)]
    docs = spark.createDataFrame([(d, t, "x", 1, 1.0) for d, t in rows], "doc_id long, text string, rank string, row int, score double").repartition(3)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, aims, resampling.Draw(longest=longest, buckets=buckets))
    assert sorted(map(str, map(tuple, got.collect()))) == resampled(rows, target, longest, buckets)


def test_cut_texts_give_the_same_counts(monkeypatch):
    con, rng = resampling.connection(), random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "b", "ç-d", "e" * 90]) for _ in range(rng.randrange(400))).encode() for _ in range(20)] + [b"", b"..", b"y" * 500]
    for longest in (1, 2, 4):
        monkeypatch.setattr(resampling, "PART", 4 << 20)
        whole = resampling.bucket_counts(con, texts, longest, 100)
        monkeypatch.setattr(resampling, "PART", 64)
        cut = resampling.bucket_counts(con, texts, longest, 100)
        assert (whole[0] == cut[0]).all() and whole[1] == cut[1] and (whole[2] == cut[2]).all()
        assert [int(resampling.unpacked(x)[1].sum()) for x in whole[1]] == whole[0].tolist()


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, "b " * 30)], "doc_id long, text string")
    assert resampling.resample(docs.where("false"), docs).count() == 0
    got = resampling.resample(docs, docs.where("false"), resampling.Draw(share=50)).collect()
    assert sorted(map(str, map(tuple, got))) == resampled([(1, "a " * 30), (2, "b " * 30)], [], share=50)
    with pytest.raises(ValueError, match="buckets"):
        resampling.resample(docs, docs, resampling.Draw(buckets=70_000))
