"""The reference's cases for each operator, properties, and both executions of merge learning."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexweave.__main__ import main
from lexweave.functions import text as T
from lexweave.operators import counts, guessed, lattice, merges, segment, unigram
from lexweave.operators.models import Bpe, BpeConfig, SentenceBpe, SentenceBpeConfig, Unigram, UnigramConfig, WordPiece, WordPieceConfig
from lexweave.plans import models
from lexweave.sources import text_files as S
from lexweave.streaming import apply


def hist(spark, column, rows):
    return spark.createDataFrame(list(Counter(rows).items()), f"{column} string, n long")


def pieces(spark, model, text, column="word"):
    one = spark.createDataFrame([(text,)], f"{column} string")
    return (model.tokenize(one) if isinstance(model, WordPiece | Unigram) else one.select(model.tokenize(column).alias("tokens"))).first()["tokens"]


@pytest.mark.parametrize(("rows", "n", "want"), [
    (["aab"] * 3 + ["ac"], 1, ["a a"]), (["abcabc"] * 100, 3, ["a b", "ab c", "abc abc"]), (["ab"] * 2 + ["cd"] * 2, 2, ["a b", "c d"]),
    (["prefixo"] * 50, 4, ["e f", "ef i", "efi x", "efix o"]), (["baixo", "baixa", "baixos"], 5, ["a i", "ai x", "b aix", "baix o"]),
])
def test_bpe_rules(spark, rows, n, want):
    words = hist(spark, "word", rows)
    for compact in (10**6, 0):
        model = Bpe.train(words, BpeConfig(n, 2), compact_symbols=compact)
        assert [f"{a} {b}" for a, b, _ in model.rules] == want
    assert "".join(pieces(spark, model, rows[0])) == rows[0]


def test_bpe_replay(spark):
    assert pieces(spark, Bpe([("a", "b", "ab")]), "abc") == ["ab", "c"]
    assert pieces(spark, Bpe([("a", "a", "aa")]), "aaaaa") == ["aa", "aa", "a"]
    assert pieces(spark, Bpe([]), "") == []
    with pytest.raises(Exception, match="U\\+0001"):
        pieces(spark, Bpe([("a", "b", "ab")]), "a\x02\x01b")


@pytest.mark.parametrize(("rows", "size", "word", "want"), [
    (["abc"] * 50, 20, "abc", ["abc"]), (["abc"], 10, "xyz", ["[UNK]"]), (["abcde"] * 3 + ["bcdef"] * 3, 8, "abcde", ["ab", "##c", "##d", "##e"]),
    (["abcdef"] * 100, 8, "abcdef", ["a", "##bcd", "##e", "##f"]), (["abcdef"] * 100, 20, "abcdef", ["abcdef"]),
])
def test_wordpiece(spark, rows, size, word, want):
    words = hist(spark, "word", rows)
    models_ = [WordPiece.train(words, WordPieceConfig(size, 1 if len(rows) == 1 else 2), compact_symbols=c) for c in (10**6, 0)]
    assert models_[0] == models_[1]
    assert pieces(spark, models_[0], word) == want


def test_sentence_bpe(spark):
    rows = hist(spark, "sentence", ["ab cd"] * 3 + ["ef gh"] * 2)
    model = SentenceBpe.train(rows, SentenceBpeConfig(20, 1.0, 2))
    assert model == SentenceBpe.train(rows, SentenceBpeConfig(20, 1.0, 2), compact_symbols=0)
    assert len(model.vocab) == 20 and len(model.rules) == 10 and pieces(spark, model, "ab cd", "sentence") == ["▁ab▁cd"]
    assert pieces(spark, SentenceBpe.train(hist(spark, "sentence", ["prefixo"] * 50), SentenceBpeConfig(15, 1.0, 2)), "prefixo", "sentence") == ["▁", "prefixo"]
    cut = SentenceBpe.train(hist(spark, "sentence", ["aab"] * 50 + ["aaz"]), SentenceBpeConfig(20, 0.99, 2))
    assert set(cut.vocab) == {"<unk>", "▁", "a", "b", "aa", "▁aa", "▁aab"}
    assert pieces(spark, cut, "aaz q", "sentence") == ["▁aa", "<unk>", "▁", "<unk>"]


@pytest.mark.parametrize("seed", range(6))
def test_both_executions_agree(spark, seed):
    rng = random.Random(seed)
    rows = Counter("".join(rng.choices("abc"[: 1 + seed % 3], k=rng.randint(1, 9))) for _ in range(60))
    words = spark.createDataFrame(list(rows.items()), "word string, n long")
    one, two = (Bpe.train(words, BpeConfig(15, 2), compact_symbols=c).rules for c in (10**6, 0))
    assert one == two


@pytest.mark.parametrize(("seed", "by_score"), [(k, s) for k in range(3) for s in (False, True)])
def test_guessed_rounds_equal_one_at_a_time(spark, seed, by_score):
    """Guesses from few rows, and few pairs at the driver: more rounds, the same rules."""
    rng = random.Random(seed)
    mark = "##" if by_score else ""
    rows = [([c if k == 0 else mark + c for k, c in enumerate(rng.choices("abcdefgh"[: 4 + 2 * seed], k=rng.randint(1, 12)))], rng.randint(1, 5)) for _ in range(80)]
    rows += [(["a", mark + "a", mark + "a", mark + "a"], 7), (["z"], 3)]
    seeds = sorted({t for tokens, _ in rows for t in tokens})
    join = merges.continued if by_score else merges.plain
    how = {"by_score": by_score, "least": 2, "done": lambda n, size: n >= 24 or size >= len(seeds) + 22, "join": join, "seeds": seeds}
    want = guessed.brute_force(rows, **how)
    assert want == merges.learn_compact(merges.Segments.of(rows), **how)
    table = spark.createDataFrame(rows, "tokens array<string>, n long").select(T.held(F.col("tokens")).alias("s"), "n")
    for head, symbols in ((7, 60), (4000, 10**6)):
        assert guessed.learn(table, **how, head=head, sample_symbols=symbols) == want
    endless = how | {"done": lambda n, size: False}
    if seed == 0:
        assert guessed.learn(table, **endless) == guessed.brute_force(rows, **endless)


def test_a_wrong_guess_changes_nothing(spark, monkeypatch):
    """Guesses of any kind, pairs that don't occur included."""
    rng = random.Random(5)
    rows = [(list("".join(rng.choices("abc", k=8))), rng.randint(1, 3)) for _ in range(40)]
    how = {"by_score": False, "least": 2, "done": lambda n, _: n >= 9, "join": merges.plain, "seeds": ["a", "b", "c"]}
    table = spark.createDataFrame(rows, "tokens array<string>, n long").select(T.held(F.col("tokens")).alias("s"), "n")

    def wild(self, head, step, first, most, join, *_):
        return [*first, *((a, b, a + b) for a, b in (rng.choices(["a", "b", "c", "ab", "q"], k=2) for _ in range(5)))]

    monkeypatch.setattr(guessed.BySample, "guess", wild)
    assert guessed.learn(table, **how) == guessed.brute_force(rows, **how)


def test_replayed_rules_are_written(spark, monkeypatch):
    monkeypatch.setattr(guessed, "REPLAYED", 3)
    rng = random.Random(8)
    rows = [(list("".join(rng.choices("abcdef", k=10))), rng.randint(1, 9)) for _ in range(60)]
    how = {"by_score": False, "least": 2, "done": lambda n, _: n >= 40, "join": merges.plain, "seeds": list("abcdef")}
    table = spark.createDataFrame(rows, "tokens array<string>, n long").select(T.held(F.col("tokens")).alias("s"), "n")
    assert guessed.learn(table, **how, most=8, sample_symbols=100) == guessed.brute_force(rows, **how)


def test_text_functions(spark):
    cases = {"hello": "▁hello", "hello  world": "▁hello▁world", "  hello\t": "▁hello", "": "", " \t ": "", "a b c": "▁a b▁c"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.marked_sentence("s")).collect()}
    assert got == cases
    row = spark.createDataFrame([("abc", "a")], "x string, y string").select(T.continuation_pieces("x"), T.continuation_pieces("y")).first()
    assert list(row) == [["a", "##b", "##c"], ["a"]]
    pairs = spark.createDataFrame([("p", "##l"), ("##a", "##y"), ("pl", "##ay")], "l string, r string")
    assert [r[0] for r in pairs.select(T.joined_pair(F.col("l"), F.col("r"))).collect()] == ["pl", "##ay", "play"]
    n = spark.createDataFrame([(10, 10, 10), (1, 0, 5)], "a long, b long, c long").select(T.pair_score(F.col("a"), F.col("b"), F.col("c")))
    assert [r[0] for r in n.collect()] == [0.1, 0.0]
    code = spark.createDataFrame([(0x2BCD1234, 0x56789ABC)], "a int, b int").select(T.packed_pair(F.col("a"), F.col("b")).alias("p"))
    assert list(code.select(*T.unpacked_pair(F.col("p"))).first()) == [0x2BCD1234, 0x56789ABC]
    seg = spark.createDataFrame([(["a", "a", "a"], 2)], "tokens array<string>, n long")
    assert [tuple(r) for r in counts.pair_counts(seg).collect()] == [("a", "a", 4)]


def test_viterbi():
    index = {"▁": -1.0, "a": -1.0, "b": -1.0, "▁a": -0.5, "▁ab": -0.1}
    closed = unigram.closed
    assert unigram.viterbi("▁ab", closed(index), 16) == (["▁ab"], -0.1)
    assert unigram.viterbi("ab", closed({"ab": -2.0, "a": -1.0, "b": -1.0}), 16)[0] == ["ab"]
    assert unigram.viterbi("▁q", {"▁": -1.0}, 16) == (["▁", "q"], -101.0)
    assert unigram.viterbi("", index, 16) == ([], 0.0)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("abc", k=rng.randint(1, 7)))
        index = {text[i:j]: -rng.random() for i in range(len(text)) for j in range(i + 1, len(text) + 1) if j - i == 1 or rng.random() < 0.5}
        best = -math.inf
        for mask in range(2 ** (len(text) - 1)):
            cut = [0, *(i for i in range(1, len(text)) if mask >> (i - 1) & 1), len(text)]
            best = max(best, sum(index.get(text[a:b], -math.inf) for a, b in zip(cut, cut[1:], strict=False)))
        tokens, lp = unigram.viterbi(text, closed(index), 16)
        assert abs(lp - best) < 1e-9 and "".join(tokens) == text


def test_unigram_training(spark):
    rows = hist(spark, "sentence", ["abcabc"] * 30)
    marked = rows.select(T.marked_sentence("sentence").alias("s"), "n")
    start = unigram.seed(marked, 50)
    after, found = unigram.em_step(marked, start)
    assert len(start.vocab) == 22 and after.log_probs != start.log_probs
    assert unigram.log_likelihood(marked, after) >= unigram.log_likelihood(marked, start)
    assert len(unigram.pruned(after, found, 0.2).vocab) == 18
    assert {"a", "b", "c", "▁"} <= set(unigram.pruned(after, found, 0.5).vocab)
    model = Unigram.train(rows, UnigramConfig(10, 10.0, 3, 0.2))
    spread, sizes = unigram.train(marked, 10, 10.0, 3, 0.2, compact_chars=0)
    assert spread.vocab == model.model.vocab and sizes == model.sizes and spread.log_probs == pytest.approx(model.model.log_probs)
    assert model.sizes == [22, 18, 15, 12, 10]
    assert set(model.model.vocab) == {"a", "b", "c", "▁", "▁a", "▁ab", "▁abc", "▁abca", "▁abcab", "▁abcabc"}
    assert sorted(round(p, 6) for p in model.model.log_probs)[0] == -26.427048
    assert Unigram.train(hist(spark, "sentence", ["abcabc"] * 3), UnigramConfig(2, 10.0, 1, 0.5)).sizes == [20, 10, 5, 4]


def test_row_by_row_segmentation_equals_columns(spark):
    """Replay in batches gives what replay in columns gives, whatever the order of the rules; greedy
    segmentation what a plain search gives."""
    from lexweave.operators import models as M

    rng = random.Random(21)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(120)})
    table = spark.createDataFrame([(w, 1) for w in [*words, ""]], "word string, n long")
    for seed in range(4):
        rng = random.Random(seed)
        parts = ["a", "b", "c"]
        rules = []
        for _ in range(25):
            a, b = rng.choice(parts), rng.choice(parts)
            rules.append((a, b, a + b))
            parts.append(a + b)
        rng.shuffle(rules)
        rules += rules[:3]
        bpe, sp = Bpe(rules), SentenceBpe(["<unk>", "a", "b", "▁"], rules)
        want = {r.word: r.t for r in table.select("word", bpe.tokenize("word").alias("t")).collect()}
        marked = {r.word: r.t for r in table.select("word", sp.tokenize("word").alias("t")).collect()}
        few, M.COLUMN_RULES = M.COLUMN_RULES, 0
        try:
            assert {r.word: r.tokens for r in bpe.segmented(table).collect()} == want
            assert {r.word: r.tokens for r in sp.segmented(table, "word").collect()} == marked
            assert {r.token: r.c for r in bpe.frequencies(table).collect()} == Counter(t for w in want.values() for t in w)
        finally:
            M.COLUMN_RULES = few
        vocab = sorted({*rng.sample(parts, 8), *("##" + p for p in rng.sample(parts, 8))})
        for w, tokens in ((r.word, r.tokens) for r in WordPiece(vocab, []).segmented(table).collect()):
            plain, at = [], 0
            while at < len(w) and plain != ["[UNK]"]:
                found = [e for e in range(at + 1, len(w) + 1) if ("##" if at else "") + w[at:e] in vocab]
                plain = [*plain, ("##" if at else "") + w[at : found[-1]]] if found else ["[UNK]"]
                at = found[-1] if found else at
            assert tokens == plain


def test_first_lines_by_split(spark, tmp_path):
    """Several files, read in many splits, and every kind of limit."""
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"line {k} {n} {'x' * (n % 40)}\n" + "# no\n\n" * (n % 3) for n in range(400)))
    want = [f"line {k} {n} {'x' * (n % 40)}".strip() for k in range(3) for n in range(400)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for limit in (1, 37, 400, 777, 1200, 5000):
            got = sorted(S.load_sentences(spark, str(tmp_path), limit).collect(), key=lambda r: r["place"])
            assert [r["sentence"] for r in got] == want[:limit]
        assert S.lines(spark, str(tmp_path)).select("place.split").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_places_without_one_task(spark):
    rows = spark.range(10_000).selectExpr("id", "id % 7 AS k").repartition(5)
    got = counts.ranked(rows, [F.desc("k"), F.asc("id")]).collect()
    want = {r["id"]: n + 1 for n, r in enumerate(sorted(got, key=lambda r: (-r["k"], r["id"])))}
    assert all(r["place"] == want[r["id"]] for r in got)
    assert counts.ranked(rows.where("false"), [F.col("id")]).count() == 0


def test_greedy_longest_match():
    """Against the longest piece found by trying all of them; a word of 100,000 characters takes linear time."""
    for seed in range(40):
        rng = random.Random(seed)
        words = ["".join(rng.choices("abcé😀#", [5, 5, 3, 1, 1, 1], k=rng.randint(0, 14))) for _ in range(60)]
        vocab = list({("##" if i and rng.random() < 0.9 else "") + w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, min(len(w), i + 4) + 1) if rng.random() < (0.8 if j == i + 1 else 0.3)})
        want = []
        for w in words:
            out, at = [], 0
            while at < len(w):
                mark = "##" if at else ""
                end = next((e for e in range(len(w), at, -1) if mark + w[at:e] in vocab), None)
                if end is None:
                    out = ["[UNK]"]
                    break
                out.append(mark + w[at:end])
                at = end
            want.append(out)
        assert segment.Greedy(vocab, block=rng.choice([20, 1 << 20]))(words).to_pylist() == want
    long = segment.Greedy(["a", "##a", "##ab", "##b"])(["a" + "ab" * 50_000])[0].as_py()
    assert long == ["a", *["##ab"] * 50_000]


def test_lattices_give_the_best_paths(spark, monkeypatch):
    """Blocks of texts against one at a time: scores, ties, unknown characters, ends that aren't reached."""
    for seed in range(40):
        rng = random.Random(seed)
        texts = ["".join(rng.choices("abc▁é😀", [4, 4, 4, 2, 1, 1], k=rng.randint(0, 30))) for _ in range(40)] + ["", "a\0b", "q", "ab" * 60]
        vocab = sorted({t[i:j] for t in texts for i in range(len(t)) for j in range(i + 1, min(len(t), i + 6) + 1) if rng.random() < (0.9 if j == i + 1 else 0.2)})
        model = unigram.Model(vocab, [-rng.choice([1.0, 1.5, 2.0, rng.random()]) for _ in vocab])
        trie, index = lattice.Trie(vocab), unigram.closed(model.index())
        monkeypatch.setattr(lattice, "CELLS", rng.choice([200, 2000, 10**6]))
        done, owner, piece, score, apart = lattice.best_pieces(texts, trie, lattice.costs(model.log_probs), lambda t: unigram.viterbi(t, index, trie.longest))
        assert {*done, *apart} == {*range(len(texts))}
        for at, k in enumerate(done):
            if k not in apart:
                assert ([vocab[x] for x in piece[owner == at]], score[at]) == unigram.viterbi(texts[k], index, trie.longest)


def test_counts_from_lattices(spark):
    rng = random.Random(3)
    rows = {"".join(rng.choices("abc▁", k=rng.randint(1, 40))): rng.randint(1, 5) for _ in range(150)} | {"ab" * 400: 2}
    marked = spark.createDataFrame(list(rows.items()), "s string, n long").repartition(3)
    first = unigram.seed(marked, 80)
    table = unigram.lattices(marked, first)
    keep = [t for t in first.vocab if len(t) == 1 or rng.random() < 0.7]
    model = unigram.Model(keep, [-rng.choice([1.0, 1.5, 2.0, rng.random()]) for _ in keep])
    want = Counter()
    for s, n in rows.items():
        for t in unigram.viterbi(s, unigram.closed(model.index()), 16)[0]:
            want[t] += n
    assert unigram.seed_of(list(rows.items()), 80) == first and unigram.Held(list(rows.items()), first.vocab).counts(model) == want
    assert unigram.counted(table, first.vocab, model) == want == unigram.em_step(marked, model)[1]


@pytest.mark.parametrize("k", [1, 7, 60, 10**6])
def test_substrings_by_suffix_order(spark, k):
    rng = random.Random(k)
    rows = [("".join(rng.choices("abcé▁", k=rng.randint(1, 30))), rng.randint(1, 4)) for _ in range(60)] + [("ab" * 300, 3), ("z", 1), ("zzzzzzzzzzzzzzzzzzzzzzzz", 2)]
    want = Counter()
    for s, n in rows:
        for i in range(len(s)):
            for j in range(i + 2, min(len(s), i + 16) + 1):
                want[s[i:j]] += n
    got = counts.top_substrings(spark.createDataFrame(rows, "s string, n long"), "s", k)
    assert got == sorted(want.items(), key=lambda x: (-x[1], x[0].encode()))[:k]


def test_dumps_and_file_order(spark, tmp_path):
    """Dump lines as they stand in the files; WordPiece ids by first occurrence; limits in file order."""
    path = tmp_path / "w.txt"
    path.write_text("zeta\nalpha\n# no\n  zeta x\nbeta\n")
    rows = S.load_words(spark, str(path))
    model = WordPiece.train(S.histogram(rows, "word", "place"), WordPieceConfig(9, 2))
    assert model.vocab[:9] == ["z", "##e", "##t", "##a", "a", "##l", "##p", "##h", "b"]
    assert [r[0] for r in models.vocab_lines(spark, model).collect()] == model.vocab
    assert [r[0] for r in S.load_words(spark, str(path), 2).collect()] == ["zeta", "alpha"]
    out = tmp_path / "vocab"
    assert main(["wordpiece", "--file", str(path), "--vocab-size", "9", "--dump-vocab", str(out)], spark) == 0
    assert "".join(f.read_text() for f in sorted(out.glob("part-*"))) == "".join(t + "\n" for t in model.vocab)
    uni = Unigram(unigram.Model(["b", "a", "ab"], [-0.5, -1.23456789, -2.0]))
    assert [r[0] for r in models.vocab_lines(spark, uni).collect()] == ["a\t-1.234568", "ab\t-2.000000", "b\t-0.500000"]
    bad = tmp_path / "bad.txt"
    bad.write_bytes(b"fine\n\xff\xfe\n")
    for limit in (None, 5):
        with pytest.raises(Exception, match="UTF8|UTF-8"):
            S.load_words(spark, str(bad), limit).collect()
    assert main(["sentence", "--file", str(bad)], spark) == 1


def test_wordpiece_over_a_stream(spark, tmp_path):
    spark.createDataFrame([("abab",), ("q",), (None,), ("",)], "word string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("word string").parquet(str(tmp_path / "in"))
    apply.to_table(apply.tokenized(stream, WordPiece(["ab", "##ab"], []), "word"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.word: r.tokens for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"abab": ["ab", "##ab"], "q": ["[UNK]"], None: [], "": []}


def test_sources_sinks_stream_and_command(spark, tmp_path, capsys):
    path = tmp_path / "words.txt"
    path.write_bytes("# note\nabcabc 7\r\n\n  abcabc\n  abd\tx\nq\n".encode())
    assert [r[0] for r in S.load_words(spark, str(path), 3).collect()] == ["abcabc", "abcabc", "abd"]
    assert sorted(r[0] for r in S.load_words(spark, str(path)).collect()) == ["abcabc", "abcabc", "abd", "q"]
    assert sorted(r[0] for r in S.load_sentences(spark, str(path)).collect()) == ["abcabc", "abcabc 7", "abd\tx", "q"]
    (tmp_path / "none.txt").write_text("# only\n")
    with pytest.raises(ValueError, match="no usable"):
        S.load_words(spark, str(tmp_path / "none.txt"))
    assert main(["bpe", "--file", str(tmp_path / "none.txt")], spark) == 1
    words = S.histogram(S.load_words(spark, str(path)), "word")
    sentences = S.histogram(S.load_sentences(spark, str(path)), "sentence")
    for k, model in enumerate([Bpe.train(words), WordPiece.train(words, WordPieceConfig(20)), SentenceBpe.train(sentences), Unigram.train(sentences, UnigramConfig(12, 2.0, 1))]):
        models.save(spark, model, str(tmp_path / f"m{k}"))
        back = models.load(spark, str(tmp_path / f"m{k}"))
        assert (back.model if isinstance(model, Unigram) else back) == (model.model if isinstance(model, Unigram) else model)
    models.dump(models.rule_lines(spark, Bpe.train(words)), str(tmp_path / "rules"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "rules")).collect()][0] == "a\tb"
    assert all("\t-" in r[0] for r in models.vocab_lines(spark, model).collect())
    assert main(["bpe", "--file", str(path), "--tokenize", "abcx"], spark) == 0
    assert capsys.readouterr().out.strip() == '["abc", "x"]'
    assert main(["wordpiece", "--file", str(path), "--vocab-size", "12", "--runs", "1", "--top-tokens", "2"], spark) == 0
    assert "rows/s" in capsys.readouterr().out
    words.select("word").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("word string").parquet(str(tmp_path / "in"))
    apply.to_table(apply.tokenized(stream, Bpe([("a", "b", "ab")]), "word"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r.word: r.tokens for r in spark.read.parquet(str(tmp_path / "out")).collect()}["abd"] == ["ab", "d"]


def test_command_line_flags(spark, tmp_path, capsys):
    """Every mode of every kind: dump before tokenize, tokenize before timing."""
    path = tmp_path / "lines.txt"
    path.write_text("abab abab\nabab\ncdcd\nabcd x\n# no\nlast line\n")
    run = lambda *args: (main([*map(str, args)], spark), capsys.readouterr().out)
    lines = lambda name: "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*"))).splitlines()
    where = ("--file", path)
    assert run("bpe", *where, "--max-words", 4, "--merges", 2, "--min-pair", 2, "--dump-rules", tmp_path / "r", "--tokenize", "x") == (0, "")
    assert lines("r") == ["a\tb", "c\td"]
    assert run("bpe", *where, "--merges", 1, "--tokenize", 'ab"\\')[1] == '["ab", "\\"", "\\\\"]\n'
    assert run("bpe", *where, "--min-pair", 99, "--tokenize", "ab")[1] == '["a", "b"]\n'
    code, out = run("bpe", *where, "--runs", 2)
    found = [float(x) for x in out.split("ms: min ")[1].replace(", mean ", " ").replace(", max ", " ").replace(";", "").split()[:3]]
    assert code == 0 and out.startswith("rows 5, characters 20, mean 4.00") and found == sorted(found)
    assert run("wordpiece", *where, "--vocab-size", 11, "--min-pair", 2, "--tokenize", "abab")[1].startswith('["ab')
    code, out = run("wordpiece", *where, "--max-words", 3, "--vocab-size", 4, "--runs", 0, "--top-tokens", 1)
    assert code == 0 and out.splitlines()[-1] == "##b\t4"
    assert run("sentence", *where, "--vocab-size", 9, "--coverage", 0.8, "--min-pair", 2, "--dump-vocab", tmp_path / "v")[0] == 0
    assert lines("v")[0] == "<unk>" and len(lines("v")) <= 9
    assert run("sentence", *where, "--max-lines", 1, "--vocab-size", 4, "--tokenize", "zz")[1] == '["▁", "<unk>", "<unk>"]\n'
    assert run("unigram", *where, "--max-lines", 3, "--vocab-size", 8, "--vocab-factor", 2, "--em-iters", 1, "--prune-ratio", 0.3, "--dump-vocab", tmp_path / "u")[0] == 0
    assert lines("u") == sorted(lines("u")) and all(len(x.split("\t")[1].split(".")[1]) == 6 for x in lines("u"))
    assert run("unigram", *where, "--vocab-size", 8, "--vocab-factor", 2, "--tokenize", "abab")[1].startswith('["▁')
    assert run("unigram", *where, "--vocab-size", 8, "--runs", 1, "--save", tmp_path / "m")[0] == 0
    assert models.load(spark, str(tmp_path / "m")).model.vocab
    for wrong in (["bpe"], ["bpe", "--file", str(path), "--merges", "many"], ["nothing"]):
        with pytest.raises(SystemExit):
            main(wrong, spark)
    assert main(["bpe", "--file", str(tmp_path / "missing")], spark) == 1
