"""Exact dedup, sharding, url filter, language, quality, packing, and the pipeline."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import common, decontaminate, exact_dedup, language, packing, quality, sharding, simhash, urls
from lexweave.llm import queries as q

SF = "/root/testdata/sf0.001"
ODD = [(3, None), (1, ""), (2, " \t\n"), (7, "a b"), (6, "ab "), (5, "ab"), (5, "ab"), (None, "a  b"), (None, "zz"), (9, "é\u00a0x"), (10, "éx"), (11, "x" * 200_000), (12, "ab\x1c")]


def frame(spark, rows=ODD):
    """With columns whose names clash with what operators make."""
    return spark.createDataFrame([(d, t, "en", "s", 1, 1.0) for d, t in rows], "doc_id long, text string, lang string, digest string, size long, score double")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1).cast("binary")) if weak else exact_dedup.sha256_of
    got = exact_dedup.exact_dedup(frame(spark).repartition(3), digest=digest).collect()
    groups = defaultdict(list)
    for d, t in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), math.inf if d is None else d, d))
    want = []
    for content, rows in groups.items():
        keep = min(rows)[2]
        want += [(d, keep, len(rows), d == keep, hashlib.sha256(content.encode()).hexdigest()) for _, _, d in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(frame(spark).where("false")).count() == 0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def placed_by_hand(rows, shards=8, slots=sharding.SLOTS):
    """(doc_id, crc, shard, slot) of every row, for tables without repeated records that are spread."""
    body = [(d, (t or "").encode()) for d, t in rows]
    hashes = [xxhash.xxh64_intdigest(t, 42) for _, t in body]
    bytes_of, n_of = Counter(), Counter()
    for (_, t), h in zip(body, hashes, strict=True):
        bytes_of[h] += len(t) + 1
        n_of[h] += 1
    bar = sum(bytes_of.values()) / slots
    found = []
    for (d, t), h in zip(body, hashes, strict=True):
        if bytes_of[h] > bar and n_of[h] > 1:
            seed = 42 if d is None else xxhash.xxh64_intdigest(struct.pack("<q", d), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
        found.append((signed(h) % slots, d, len(t) + 1, zlib.crc32(t)))
    loads = Counter()
    for v, _, size, _ in found:
        loads[v] += size
    totals, owner = [0] * shards, {}
    for v in sorted(range(slots), key=lambda v: (-loads[v], v)):
        owner[v] = min(range(shards), key=lambda s: (totals[s], s))
        totals[owner[v]] += loads[v]
    out, at = [], Counter()
    for v, d, size, crc in sorted(found, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], x[3])):
        out.append((d, size, crc, owner[v], at[owner[v]]))
        at[owner[v]] += 1
    return out


def test_one_of_each_text(spark, tmp_path):
    """Row by row: repeats, ties and null ids; every column stays."""
    rows = [*ODD, (7, "a b"), (20, "q q"), (None, "q  q "), (None, "only"), (None, "only")]
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for digest in (exact_dedup.sha256_of, lambda c: F.substring(F.sha2(c, 256), 1, 1).cast("binary")):
        kept = exact_dedup.one_of_each(docs, digest=digest)
        assert kept.columns == docs.columns
        best = {}
        for d, t in rows:
            key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
            best[key] = min(best.get(key, (1,)), (-len(t or ""), math.inf if d is None else d, d, t), key=lambda x: x[:2])
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((b[2], b[3]) for b in best.values()), key=str)
    assert exact_dedup.one_of_each(docs.where("false")).count() == 0
    mapped = simhash.written(docs.withColumn("m", F.create_map(F.lit("a"), F.lit(1))))  # no hash or order of its own
    assert exact_dedup.one_of_each(mapped).count() == len(best)
    near = simhash.brute_force({k: t for k, (_, t) in enumerate(rows) if t != "x" * 200_000})
    assert simhash.one_of_each(mapped, simhash.NARROW).count() == len({root for _, root in near.values()}) + 1


def test_sharding(spark, tmp_path):
    rows = [r for r in ODD if r != (5, "ab")] + [(5, "ab")] + [(k, "w" * (k % 900) + str(k % 50)) for k in range(100, 1500)] + [(k, "copy of one text " * 9) for k in range(5000, 5600)]
    docs = frame(spark, rows)
    got = sharding.shard(docs, 8, map_folder=str(tmp_path / "first")).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=str) == sorted(placed_by_hand(rows), key=str)
    one = sharding.SlotMap.load(spark, str(tmp_path / "first"))
    assert one.version == 1 and one == sharding.plan(docs) and len(one.spread_texts) > 0
    totals, shards_of = Counter(), defaultdict(set)
    for r in got:
        totals[r.shard] += r["size"]
        shards_of[r.text_crc32].add(r.shard)
    loads = {s: b for s, (b, _) in sharding.slot_loads(sharding.shard(docs, 8)).items()}
    assert max(totals.values()) - min(totals.values()) <= max(loads.values())
    # copies share a shard unless they are more than a slot's share; the longest text fills a shard alone
    assert len(shards_of[zlib.crc32(("copy of one text " * 9).encode())]) == 7
    two = sharding.rebalanced(one, loads, 9)
    assert two.version == 2 and two.spread_texts == one.spread_texts and all(two.owner[s] == one.owner[s] for s in range(sharding.SLOTS) if s not in two.moved)
    two.save(spark, str(tmp_path / "first"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "first")) == two and sharding.SlotMap.load(spark, str(tmp_path / "first"), 1) == one
    with pytest.raises(ValueError, match="already"):
        two.save(spark, str(tmp_path / "first"))
    with pytest.raises(LookupError):
        sharding.SlotMap.load(spark, str(tmp_path / "first"), 7)
    own = docs.withColumn("shard", F.lit("mine"))
    name = sharding.write_shards(own, str(tmp_path / "out"), one)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and back.count() == len(rows) and back.where("shard = 'mine'").count() == len(rows)
    assert {(r.doc_id, r.shard_) for r in back.collect()} == {(r.doc_id, r.shard) for r in got}
    assert sharding.shard(docs.where("false"), 8).count() == 0


def test_sharding_groups_and_repeated_records(spark):
    small = [(k, f"text {k % 400}") for k in range(4000)]
    got = sharding.shard(frame(spark, small), 8, slots=64).collect()
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    hot = [(1, "one record")] * 3000 + [(k, f"t{k}") for k in range(3000)]
    totals = Counter()
    for r in sharding.shard(frame(spark, hot), 8).collect():
        totals[r.shard] += r["size"]
    assert max(totals.values()) < 1.02 * min(totals.values())


def test_shards_are_written_where_they_are_told(spark, tmp_path):
    """Rows of spread records too, whatever the layout of the table."""
    hot = frame(spark, [(1, "one record")] * 3000 + [(k, f"t{k}") for k in range(3000)])
    one = sharding.plan(hot, 8)
    assert one.spread_records
    for k, docs in enumerate((hot.repartition(3), hot.repartition(7, "doc_id"), hot.coalesce(1))):
        table = common.numbered(docs)
        told = Counter((r.doc_id, r.shard) for r in sharding.shard(table, slot_map=one, whole=True).collect())
        name = sharding.write_shards(table, str(tmp_path / str(k)), one, whole=True)
        back = spark.read.parquet(str(tmp_path / str(k)))
        assert set(back.columns) == {*hot.columns, name}
        assert Counter((r.doc_id, r[name]) for r in back.collect()) == told


def test_one_of_each_of_any_layout(spark):
    """The plan reads the table several times with other columns; no text is lost however it is split."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()}
    near = None
    for table in (docs, docs.repartition(4), docs.repartition(9, "lang")):
        kept = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in exact_dedup.one_of_each(table).collect()]
        assert len(kept) == len(set(kept)) and set(kept) == texts
        ids = sorted(r.doc_id for r in simhash.one_of_each(table, simhash.NARROW).collect())
        near = near or ids
        assert ids == near


URLS = [
    (1, "https://a.ORG/x", "a.org", "/x", "org/", "allow"), (2, "http://org/", "org", "/", "org/", "allow"), (3, "http://m.example.org/es/9?a#b", "m.example.org", "/es/9", "example.org/es/", "block"),
    (4, "http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), (5, "http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), (6, "http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    (7, "http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), (8, "http://a.org?q=/x", "a.org", "", None, None), (9, None, "", "", None, None), (10, "no url", "", "", None, None), (11, "http://borg/", "borg", "/", None, None),
    (12, "://Ä.org/", "Ä.org", "/", "org/", "allow"), (13, "", "", "", None, None), (14, "a://b://c.org/", "b:", "//c.org/", None, None), (1, "https://a.ORG/x", "a.org", "/x", "org/", "allow"),
]


def test_url_rules_and_trees(spark):
    pages = spark.createDataFrame([(p, u, "h", "r") for p, u, *_ in URLS] + [(15, "http://x.com/" + "y" * 9000, "h", "r")], "page_id long, url string, host string, rule string")
    got = [r for r in urls.judge(pages, q.URL_RULES).collect() if r.page_id != 15]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted((u[:1] + u[2:5] for u in URLS), key=str)
    verdicts = {u[0]: u[5] for u in URLS}
    assert all(r.verdict == verdicts[r.page_id] or (verdicts[r.page_id] is None and r.verdict in ("allow", "block")) for r in got)
    assert urls.judge(pages.where("false"), q.URL_RULES).count() == 0
    rng = random.Random(4)
    made = [("http://h%d.net/%s/%d" % (rng.randint(0, 9), rng.choice(["a", "b/c/d/e"]), rng.randint(0, 99)),) for _ in range(300)]
    host, path = urls.parts_of(F.col("url"))
    rows = spark.createDataFrame(made, "url string").select("url", host.alias("host"), path.alias("path")).withColumn("blocked", F.contains("path", F.lit("/c/")).cast("int"))
    model = urls.learn(rows)
    assert model.edges == urls.learn(rows.repartition(3)).edges and model.trees == urls.learn(rows.repartition(3)).trees
    judged = urls.judge(rows.select(F.lit(1).alias("page_id"), "url"), [], model=model)
    wrong = judged.where((F.col("verdict") == "block") != F.contains("path", F.lit("/c/"))).count()
    assert wrong == 0


def test_url_trees_against_brute_force(spark):
    """The first tree's splits are the best there are, its leaves the steps of their rows."""
    rng = random.Random(9)
    made = sorted({("http%s://%s%d.%s/%s/%d?a=%d" % (rng.choice(["", "s"]), rng.choice(["cas-", "n"]), rng.randint(0, 30), rng.choice(["com", "net"]), rng.choice(["de", "fr", "x/y/z"]), rng.randint(0, 9999), rng.randint(0, 9)),) for _ in range(400)})
    host, path = urls.parts_of(F.col("url"))
    rows = spark.createDataFrame(made, "url string").select("url", host.alias("host"), path.alias("path")).withColumn("blocked", (F.contains("host", F.lit("cas-")) & (F.crc32(F.col("url").cast("binary")) % 5 > 0) | F.contains("path", F.lit("/9"))).cast("int"))
    model = urls.learn(rows, rounds=1, depth=2, rate=0.5, bins=8)
    binned = model.bins(model.values(F.col("url"), F.col("host"), F.col("path")))
    names = sorted(binned)
    got = rows.select("blocked", *[binned[k].alias(k) for k in names]).collect()
    x, y = np.array([[r[k] for k in names] for r in got]), np.array([r.blocked for r in got])
    p = 1 / (1 + np.exp(-model.bias))
    g, h = np.round((y - p) * 1e6) / 1e6, np.full(len(y), round(p * (1 - p), 6))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)

    def gain(m, f, b):
        left, right = m & (x[:, f] <= b), m & (x[:, f] > b)
        return score(left) + score(right) - score(m) if min(h[left].sum(), h[right].sum()) >= 1 else -1

    def check(tree, m, depth):
        best = max([gain(m, f, b) for f in range(len(names)) for b in range(x[:, f].max() + 1)]) if depth < 2 else -1
        if isinstance(tree, float):
            assert best <= 1e-6 and abs(tree - 0.5 * g[m].sum() / (h[m].sum() + 1)) < 1e-5
            return 0
        name, at, low, high = tree
        f = names.index(name)
        assert gain(m, f, at) >= best - 1e-6
        return 1 + check(low, m & (x[:, f] <= at), depth + 1) + check(high, m & (x[:, f] > at), depth + 1)

    assert check(model.trees[0], np.ones(len(y), bool), 0) >= 2
    judged = urls.judge(spark.createDataFrame([(None, made[0][0], 1.0), (None, None, 1.0)], "page_id long, url string, score double"), [], model=model).collect()
    assert [r.page_id for r in judged] == [None, None]


def test_urls_of_held_out_hosts(spark):
    """Trees learned from the ruled urls of some hosts tell those of others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = urls.parts_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("said", urls.matched(q.URL_RULES, F.col("host"), F.col("path"), "verdict")).where("said is not null")
    held = F.pmod(F.xxhash64("host"), F.lit(4)) == 0
    model = urls.learn(rows.where(~held).select("url", "host", "path", (F.col("said") == "block").cast("int").alias("blocked")))
    told = urls.judge(rows.where(held).select("page_id", "url"), [], model=model).join(rows.select("page_id", "said"), "page_id")
    assert told.where("said = verdict").count() >= 0.9 * told.count()


def test_url_entropy_of_whole_strings(spark):
    made = ["x" * 5000 + "y" * 5000, "", "aab\n\n\U0001f600é.*", "abc" * 200_000, "q" * 300 + "r" * 300]
    rows = spark.createDataFrame(list(enumerate(made)), "k int, u string")
    values = urls.features(F.col("u"), F.col("u"), F.lit(""))
    for r in rows.select("k", values["entropy"].alias("e"), values["host_entropy"].alias("h")).collect():
        n = len(made[r.k])
        want = -sum(c / n * math.log2(c / n) for c in Counter(made[r.k]).values())
        assert abs(r.e - want) < 2e-6 and abs(r.h - want) < 2e-6, (r, want)


def bits(text, train, order=3):
    """Code length by explicit contexts, escapes and exclusions."""
    table = defaultdict(Counter)
    for t in train:
        seq = [256] * order + list(t)
        for i in range(order, len(seq)):
            for d in range(order + 1):
                table[tuple(seq[i - d : i][::-1])][seq[i]] += 1
    table = {c: n for c, n in table.items() if not c or sum(n.values()) >= 2}
    total, seq = 0.0, [256] * order + list(text)
    for i in range(order, len(seq)):
        depth, excluded = order, set()
        while tuple(seq[i - depth : i][::-1]) not in table:
            depth -= 1
        while True:
            left = {s: n for s, n in table[tuple(seq[i - depth : i][::-1])].items() if s not in excluded}
            n = sum(left.values())
            if seq[i] in left:
                total -= math.log2(left[seq[i]] / (n + len(left)))
                break
            if left:
                total -= math.log2(len(left) / (n + len(left)))
                excluded |= set(left)
            if not depth:
                total += math.log2(256 - len(excluded))
                break
            depth -= 1
    return total


def test_language_code_lengths(spark):
    train = {"en": [b"the cat and the hat", b"then a hat"], "de": ["der Hut und die Kätzchen".encode(), b"die Hutte"]}
    grams = {la: Counter() for la in train}
    for la, texts in train.items():
        for t in texts:
            seq = [256] * 3 + list(t)
            for i in range(3, len(seq)):
                grams[la][((seq[i - 3] * 512 + seq[i - 2]) * 512 + seq[i - 1]) * 512 + seq[i]] += 1
    model = language.build({la: dict(c) for la, c in grams.items()}, 3, 10_000)
    texts = [b"the hat", "die Kätze".encode(), b"", b"zq\xff\x00", b"the cat and the hat" * 9]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    for chunk in (1 << 20, 7):
        got = model.classify(raw, offsets, chunk)
        want = [[bits(t, train[la]) for la in model.languages] for t in texts]
        assert np.allclose(got, want, rtol=1e-5, atol=1e-3)
    told = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, [(1, "the cat"), (2, None), (3, "12 ."), (4, ""), (5, "die Hut" * 9000)]), model).collect()}
    assert told[1][0] == "en" and told[5][0] == "de" and told[2] == told[3] == told[4] == ("und", 0.0) and 0.5 < told[1][1] <= 1
    assert language.identify(frame(spark).where("false"), model).count() == 0
    none = language.learn(frame(spark).where("false"))
    assert {r.lang_pred for r in language.identify(frame(spark), none).collect()} == {"und"}


def test_many_languages_and_letters(spark):
    """Each of 70 languages is learned; only letters make a text tell a language; rows stay rows."""
    rng = random.Random(6)
    speak = {f"l{k:02d}": [" ".join("".join(chr(0x61 + (k * 7 + rng.randint(0, 5) * (k % 9 + 1)) % 26) for _ in range(5)) + chr(0x4E00 + k) for _ in range(12)) for _ in range(6)] for k in range(70)}
    rows = [(k, t, la) for k, (la, t) in enumerate((la, t) for la, texts in speak.items() for t in texts[:5])]
    model = language.learn(spark.createDataFrame([*rows, (None, None, "l00"), (1, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == sorted(speak)
    asked = [(k, texts[5]) for k, texts in enumerate(speak.values())] + [(100 + k, t) for k, t in enumerate(["½ 12", "²", "Ⅷ ①", "_", "\u0301", None])] + [(None, speak["l03"][5]), (3, speak["l03"][5])]
    docs = spark.createDataFrame([(d, t, "x", "y", 0.5, "r") for d, t in asked], "doc_id long, text string, lang_pred string, rest string, bits_per_byte double, row string")
    told = Counter((r.doc_id, r.lang_pred) for r in language.identify(docs, model).collect())
    assert told[3, "l03"] == 2 and told[None, "l03"] == 1
    assert sum(told[k, f"l{k:02d}"] > 0 for k in range(70)) >= 68 and all(told[100 + k, "und"] for k in range(6))
    whole = language.identify(docs, model, whole=True)
    assert whole.select("row.*").columns == docs.columns and whole.count() == len(asked)


def test_language_and_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    told = q.op2_language(spark, SF).join(docs, "doc_id").where("held_out")
    assert told.where("lang = lang_pred").count() >= 0.95 * told.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = q.op10_quality(spark, SF).join(labels, "doc_id").where("held_out")
    assert scored.where("predicted = quality").count() >= 0.75 * scored.count()


def test_quality_machine(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["good", "fine", "text"] if k % 2 else ["bad", "b@d", "worse"], k=20))) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(200)] + [(None, 1, None), (5, None, None)], "doc_id long, quality int, text string")
    machine = quality.learn(frame(spark, rows), labels)
    got = {r.doc_id: r for r in quality.score(frame(spark, rows + [(900, None), (901, ""), (902, "x" * 300_000)]), machine).collect()}
    assert all((got[k].score > 0.5) == bool(k % 2) for k in range(200)) and got[900].score == got[901].score
    assert {r.score for r in quality.score(frame(spark), quality.learn(frame(spark), labels.where("false"))).collect()} == {0.5}
    assert quality.score(frame(spark).where("false"), machine).count() == 0
    assert sorted(str(r.doc_id) for r in quality.score(frame(spark), machine).collect()) == sorted(str(d) for d, _ in ODD)
    assert {r.score for r in quality.score(frame(spark), quality.learn(frame(spark).where("false"), labels)).collect()} == {0.5}
    idx, weight, at, stats = quality.featurise(np.frombuffer(b"a b ac", np.uint8), np.array([0, 3, 3, 6]), 64)
    assert np.diff(at).tolist() == [2, 0, 1]
    one = machine.margin(idx, weight, at, stats)
    z = np.clip((stats - machine.mean) / machine.scale, -6, 6)
    for r in range(3):
        x = np.zeros(len(machine.linear))
        x[idx[at[r] : at[r + 1]]] = weight[at[r] : at[r + 1]]
        x[machine.buckets :] = z[r]
        pairs = sum(machine.factors[i] @ machine.factors[j] * x[i] * x[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
        assert abs(one[r] - (machine.bias + machine.linear @ x + pairs)) < 1e-6


def check_packed(rows, texts):
    known = packing.encoder(q.tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, own in by_doc.items():
        ids = [*known.slow.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return by_doc, by_seq


def test_packing(spark):
    rows = [(1, None), (2, ""), (3, "İstanbul 'S don't ½ <|endoftext|> <|ENDOFTEXT|> a\x00b \x01 日本 é e\u0301 Σ"), (4, "word " * 20_000), (5, "w " * 4095), (6, "x")]
    by_doc, _ = check_packed(packing.pack(frame(spark, rows), q.tokenizer_path()).collect(), dict(rows))
    assert set(by_doc) == {1, 2, 3, 4, 5, 6} and len(by_doc[5]) == 1
    assert packing.pack(frame(spark, rows).where("false"), q.tokenizer_path()).count() == 0
    same = packing.pack(frame(spark, [(7, "a b")] * 3), q.tokenizer_path()).collect()
    assert len(same) == 3 and len({(r.sequence_id, r.offset) for r in same}) == 3
    # the index scores as the formula does
    terms = [np.array([[1, 5], [2, 1]], "<u4").tobytes(), np.array([[5, 9], [3, 1]], "<u4").tobytes(), np.array([[7], [1]], "<u4").tobytes()]
    lengths = np.array([10, 20, 30])
    got = packing.Bm25(terms, lengths).scores(0)
    want = math.log1p((3 - 2 + 0.5) / 2.5) * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 20 / 20))
    assert abs(got[1] - want) < 1e-9 and got[2] == 0


def test_packing_indexes_all_ids():
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)} {k}" for k in range(300)) + " common" * 300
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, ""])], ["doc_id", "text"])
    (out,) = packing._cut(q.tokenizer_path(), 4096, 2)(iter([batch]))
    got = np.frombuffer(out.column("terms")[0].as_py(), "<u4").reshape(2, -1).tolist()
    want = Counter(packing.encoder(q.tokenizer_path()).slow.encode(text, add_special_tokens=False).ids)
    assert dict(zip(*got, strict=True)) == want and len(want) > 48 and out.column("terms")[1].as_py() == b""


def test_fill_against_brute_force():
    """Seeds, neighbours and what closes a sequence, step by step, with scores from the formula."""
    rng = random.Random(12)
    for _ in range(12):
        docs = [Counter(rng.choices(range(30), k=rng.randint(1, 25))) for _ in range(40)]
        lengths = [sum(d.values()) + 1 + rng.randint(0, 3) for d in docs]
        window, mean = 64, sum(lengths) / len(lengths)
        df = Counter(t for d in docs for t in d)

        def score(seed, other):
            total = 0.0
            for t in docs[seed]:
                if t in docs[other]:
                    tf = docs[other][t]
                    total += math.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[other] / mean))
            return total

        left, want = set(range(40)), []
        while left:
            row = [max(left, key=lambda i: (lengths[i], i))]
            left -= {row[0]}
            room = window - lengths[row[0]]
            near = sorted((i for i in left if lengths[i] <= room and score(row[0], i) > 0), key=lambda i: (-round(score(row[0], i), 9), i))
            for i in near:
                if not left or min(lengths[k] for k in left) > room:
                    break
                if lengths[i] <= room and (lengths[i] == room or room - lengths[i] >= min(lengths[k] for k in left)):
                    row.append(i)
                    left -= {i}
                    room -= lengths[i]
            while fitting := [i for i in left if lengths[i] <= room]:
                row.append(max(fitting, key=lambda i: (lengths[i], i)))
                left -= {row[-1]}
                room -= lengths[row[-1]]
            want.append(row)
        terms = [np.array([sorted(d), [d[t] for t in sorted(d)]], "<u4").tobytes() for d in docs]
        assert packing.fill(np.array(lengths), packing.Bm25(terms, np.array(lengths)), window) == want


def test_shards_by_content(spark):
    """Remainders that speak alike meet; every row has a shard, none holds too many, and copies are split."""
    rng = random.Random(4)
    topics = [[rng.randint(0, 40_000) for _ in range(60)] for _ in range(8)]
    made = []
    for k in range(1600):
        ids = sorted(set(rng.choices(topics[k % 8], k=20)))
        made.append((k, 5, None, 0, 21, k, bytearray(np.array([ids, [1] * len(ids)], "<u4").tobytes())))
    made += [(5000 + k, 5, None, 0, 2, 7, bytearray(made[0][6])) for k in range(900)] + [(9000, 1, None, None, None, None, None), (9001, 1, None, 0, 1, 3, bytearray())]
    cut = packing.written(spark.createDataFrame(made, packing._CUT).withColumn("row", F.monotonically_increasing_id()))
    one, two = ({r.doc_id: r.shard for r in packing.sharded(cut, 200, 512).collect()} for _ in range(2))
    assert one == two and len(one) == len(made)
    sizes = Counter(one.values())
    assert max(sizes.values()) < 320
    together = sum(one[a] == one[b] for a in range(0, 1600) for b in (a + 8, a + 16) if b < 1600)
    assert together > 0.6 * 3176
    assert packing.sharded(cut.where("false"), 200, 512).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    told = language.identify(docs, language.learn(docs.where(q.crc_fold("doc_id", 4) != 2)))
    kept = sorted(r.doc_id for r in told.collect() if r.lang_pred != "und" and r.score >= 0.5)
    best = {}
    for d in kept:
        key = re.sub(r"[\x20\x09-\x0D]", "", texts[d])
        best[key] = min(best.get(key, (0, d)), (-len(texts[d]), d))
    kept = sorted(d for _, d in best.values())
    near = simhash.brute_force({d: texts[d] for d in kept}, simhash.WIDE)
    kept = [d for d in kept if near[d][1] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = decontaminate.brute_force([(d, texts[d]) for d in kept], items)
    kept = [d for d in kept if not leaked[d][4]]
    by_doc, _ = check_packed(corpus_pipeline.run(spark, SF).collect(), texts)
    assert sorted(by_doc) == kept
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty texts, ties, repeated rows and columns that clash with what the stages make."""
    whole = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").orderBy("doc_id").limit(60).collect()
    text = max((r.text for r in whole if r.lang == "en"), key=len)
    names = "doc_id long, text string, lang string, __row long, row string, fp string, digest string, shard int, terms string, score double, items string, first long"
    rows = [(r.doc_id, r.text, r.lang) for r in whole] + [(None, None, None), (7000, "", "en"), (7001, "12 .", "en"), (8000, text, "en"), (8000, text, "en"), (None, text, "en")]
    for empty in (False, True):
        folder = tmp_path / str(empty)
        table = spark.createDataFrame([(d, t, la, 1, "r", "f", "d", 2, "t", 0.5, "i", 9) for d, t, la in rows], names)
        (table.where("false") if empty else table).write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
        stage, sizes = spark.read.parquet(str(folder / "documents.parquet")), []
        for _, f in corpus_pipeline.STAGES[:-1]:
            stage = simhash.written(f(spark, stage, str(folder)))
            assert stage.columns == table.columns
            sizes.append(Counter(r.doc_id for r in stage.collect()))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in out} == set(sizes[-1])
        if empty:
            assert not out
            continue
        assert sizes[0][8000] == 2 and sizes[0][None] == 1 and not {7000, 7001} & set(sizes[0])
        assert sizes[1][8000] == 0 and sizes[1][None] == 0  # the first of the same texts has the smallest id
        assert all(n == 1 for n in sizes[1].values())
