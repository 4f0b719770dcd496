"""Registered queries over `documents`, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import counts, merges, unigram
from ..operators.models import Bpe, BpeConfig, SentenceBpe, SentenceBpeConfig, Unigram, UnigramConfig, WordPiece, WordPieceConfig
from ..sources import text_files as S
from . import models
from .tables import written


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(S.words_of(_documents(spark, sf_dir)), "word")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(S.sentences_of(_documents(spark, sf_dir)), "sentence")


def _placed(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    """(doc_id, place, value) of what the pattern parts texts into."""
    return S.spread(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", pattern)).alias("place", "value"))


def _placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with where each stands first."""
    return S.histogram(_placed(spark, sf_dir, r"\s+").select(F.col("value").alias("word"), F.struct("doc_id", "place").alias("at")), "word", "at")


def _placed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, n, first): marked sentences with where each stands first."""
    rows = S.useful(_placed(spark, sf_dir, "\n")).select(T.marked_sentence("value").alias("s"), F.struct("doc_id", "place").alias("at"))
    return written(S.histogram(rows, "s", "at"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct marked sentences, shuffled once; blank ones go."""
    return S.histogram(S.sentences_of(_documents(spark, sf_dir)).select(T.marked_sentence("sentence").alias("s")), "s")


def _line(tokens) -> object:
    return F.array_join(tokens, "|")


def _rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(k, a, b, m) for k, (a, b, m) in enumerate(rules)], "rank int, l string, r string, merged string")


_BPE, _WP, _SP, _UNI = BpeConfig(20, 2), WordPieceConfig(160, 2), SentenceBpeConfig(100, 0.9995, 2), UnigramConfig(300, 2.0, 1, 0.2)


def scan_words(spark, sf_dir):
    """First fields of useful lines, with how often each occurs."""
    rows = S.useful(_documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("value")))
    return S.histogram(rows.select(S.first_field().alias("word")), "word")


def scan_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir)


def scan_limit(spark, sf_dir):
    """The first 50 useful lines, by document and line."""
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return S.limited(S.useful(rows), 50, "doc_id", "line_no").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "value")


def pair_counts_top(spark, sf_dir):
    segments = _words(spark, sf_dir).select(T.characters("word").alias("tokens"), "n")
    return counts.top_pairs(counts.pair_counts(segments), 20, 2)


def pair_counts_all(spark, sf_dir):
    return counts.pair_counts(_words(spark, sf_dir).select(T.characters("word").alias("tokens"), "n"))


def wordpiece_pretokenize(spark, sf_dir):
    return _words(spark, sf_dir).select("word", _line(T.continuation_pieces("word")).alias("pieces"))


def wordpiece_token_counts(spark, sf_dir):
    return counts.token_counts(_words(spark, sf_dir).select(T.continuation_pieces("word").alias("tokens"), "n"))


def wordpiece_pair_scores(spark, sf_dir):
    segments = _words(spark, sf_dir).select(T.continuation_pieces("word").alias("tokens"), "n")
    marginal = counts.token_counts(segments)
    pairs = counts.pair_counts(segments).where("c >= 2")
    sides = pairs.join(marginal.select(F.col("token").alias("l"), F.col("c").alias("cl")), "l").join(marginal.select(F.col("token").alias("r"), F.col("c").alias("cr")), "r")
    scored = sides.select("l", "r", "c", T.pair_score(F.col("c"), F.col("cl"), F.col("cr")).alias("score"), T.joined_pair(F.col("l"), F.col("r")).alias("merged"))
    return scored.withColumn("score", F.round("score", 12))


def normalize_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir).select("sentence", T.marked_sentence("sentence").alias("marked"))


def corpus_stats_words(spark, sf_dir):
    return counts.corpus_stats(_words(spark, sf_dir), "word")


def corpus_stats_sentences(spark, sf_dir):
    return counts.corpus_stats(_sentences(spark, sf_dir), "sentence")


def character_frequency(spark, sf_dir):
    return counts.character_counts(_marked(spark, sf_dir), "s")


def character_coverage(spark, sf_dir):
    return counts.coverage_cut(counts.character_counts(_marked(spark, sf_dir), "s"), 0.99)


def covered_sentences(spark, sf_dir):
    """Segmentations with <unk> for what a coverage of 0.99 leaves out, counted by token. A character is a
    token wherever it stands, so they are summed from the characters' counts."""
    chars = written(counts.character_counts(_marked(spark, sf_dir), "s"))
    kept = [r["ch"] for r in counts.coverage_cut(chars, 0.99).collect()]  # an alphabet
    return counts.token_counts(chars.select(T.covered(F.array("ch"), kept).alias("tokens"), F.col("c").alias("n")))


def first_seen_vocabulary(spark, sf_dir):
    """Characters of words numbered by first occurrence: document, word, place."""
    tokens = counts.first_characters(S.spread(_documents(spark, sf_dir).select("doc_id", "text")), "text", ["doc_id"], words=True)
    return counts.first_seen_ids(tokens).withColumn("token_id", F.col("token_id").cast("long"))


def packed_pairs(spark, sf_dir):
    """Pairs of character codes packed into one number and taken apart again."""
    pairs = pair_counts_all(spark, sf_dir).select(F.ascii("l").alias("a"), F.ascii("r").alias("b")).distinct()
    both = pairs.select("a", "b", T.packed_pair(F.col("a"), F.col("b")).alias("packed"))
    left, right = T.unpacked_pair(F.col("packed"))
    return both.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "packed", left.cast("long").alias("left"), right.cast("long").alias("right"))


def seed_substrings(spark, sf_dir):
    """The 300 most frequent substrings of two to sixteen characters of marked sentences."""
    return spark.createDataFrame(counts.top_substrings(written(_marked(spark, sf_dir)), "s", 300), "token string, c long")


def bpe_train(spark, sf_dir):
    return _rules(spark, Bpe.train(_words(spark, sf_dir), _BPE).rules).drop("merged")


def bpe_train_distributed(spark, sf_dir):
    """The same rules by the table-at-a-time loop."""
    return _rules(spark, Bpe.train(_words(spark, sf_dir), _BPE, compact_symbols=0).rules).drop("merged")


def bpe_tokenize(spark, sf_dir):
    words = written(_words(spark, sf_dir))
    return words.select("word", _line(Bpe.train(words, _BPE).tokenize("word")).alias("tokens"))


def bpe_token_frequencies(spark, sf_dir):
    words = written(_words(spark, sf_dir))
    return Bpe.train(words, _BPE).frequencies(words)


def bpe_tokens_per_word(spark, sf_dir):
    words = written(_words(spark, sf_dir))
    tokens = Bpe.train(words, _BPE).frequencies(words).agg(F.sum("c").alias("c"))
    return tokens.crossJoin(words.agg(F.sum("n").alias("n"))).select(F.round(F.col("c") / F.col("n"), 6).alias("tokens_per_word"))


def sentence_bpe_train(spark, sf_dir):
    return _rules(spark, SentenceBpe.train_marked(_marked(spark, sf_dir), SentenceBpeConfig(90, 0.9995, 2)).rules)


def sentence_bpe_vocabulary(spark, sf_dir):
    """Ids by first occurrence: document, line, place."""
    vocab = SentenceBpe.train_marked(_placed_sentences(spark, sf_dir), _SP).vocab
    return spark.createDataFrame(list(enumerate(vocab)), "token_id int, token string")


def sentence_bpe_frequencies(spark, sf_dir):
    rows = written(_marked(spark, sf_dir))
    return SentenceBpe.train_marked(rows, _SP).frequencies_marked(rows)


def _ten_more(words: DataFrame) -> WordPieceConfig:
    """Room for ten merges."""
    return WordPieceConfig(10 + merges.first_tokens(words.select(F.col("word").alias("s"), "n"), merges.Start(continues=True)).count(), 2)


def wordpiece_train(spark, sf_dir):
    words = written(_words(spark, sf_dir))
    return _rules(spark, WordPiece.train(words, _ten_more(words)).rules)


def wordpiece_train_distributed(spark, sf_dir):
    """The same rules by guessed rounds over a table."""
    words = written(_words(spark, sf_dir))
    return _rules(spark, WordPiece.train(words, _ten_more(words), compact_symbols=0).rules)


def wordpiece_vocabulary(spark, sf_dir):
    """Ids by first occurrence: document, word, place."""
    words = written(_placed_words(spark, sf_dir))
    vocab = WordPiece.train(words, _ten_more(words)).vocab
    return spark.createDataFrame(list(enumerate(vocab)), "token_id int, token string")


def sentence_bpe_train_distributed(spark, sf_dir):
    """The same rules by guessed rounds over a table."""
    return _rules(spark, SentenceBpe.train_marked(_marked(spark, sf_dir), SentenceBpeConfig(90, 0.9995, 2), compact_symbols=0).rules)


def wordpiece_tokenize(spark, sf_dir):
    """Greedy pieces from a vocabulary of all single pieces that occur often and the commonest bigrams."""
    words = _words(spark, sf_dir)
    return words.select("word").join(_greedy_model(words).tokenize(words), "word").select("word", _line("tokens").alias("tokens"))


def wordpiece_frequencies(spark, sf_dir):
    words = _words(spark, sf_dir)
    return _greedy_model(words).frequencies(words)


def _greedy_model(words: DataFrame) -> WordPiece:
    segments = words.select(T.continuation_pieces("word").alias("tokens"), "n")
    single = [r["token"] for r in counts.token_counts(segments).where("c >= 50").select("token").collect()]  # an alphabet
    pairs = counts.top_pairs(counts.pair_counts(segments), 200).select(T.joined_pair(F.col("l"), F.col("r")).alias("m")).collect()
    return WordPiece(sorted({*single, *(r["m"] for r in pairs)}), [])


def _seeded(spark, sf_dir) -> tuple[DataFrame, unigram.Model]:
    marked = written(_marked(spark, sf_dir))  # read several times
    return marked, unigram.seed(marked, 400)


def unigram_seed(spark, sf_dir):
    _, model = _seeded(spark, sf_dir)
    return spark.createDataFrame([(t, round(p, 6)) for t, p in zip(model.vocab, model.log_probs, strict=True)], "token string, log_prob double")


def unigram_tokenize(spark, sf_dir):
    """Best paths under the seed model, all pieces being equally likely."""
    marked, model = _seeded(spark, sf_dir)
    return unigram.segmented(marked.select("s"), model, "s").select("s", _line("tokens").alias("tokens"), F.round("lp", 6).alias("lp"))


def unigram_frequencies(spark, sf_dir):
    """How often each piece occurs on the best paths of all sentences."""
    marked, model = _seeded(spark, sf_dir)
    return Unigram(model).frequencies_marked(marked)


def unigram_em_step(spark, sf_dir):
    marked, model = _seeded(spark, sf_dir)
    model, found = unigram.em_step(marked, model)
    return spark.createDataFrame([(t, float(found.get(t, 0.0)), round(p, 6)) for t, p in zip(model.vocab, model.log_probs, strict=True)], "token string, c double, log_prob double")


def unigram_log_likelihood(spark, sf_dir):
    marked, model = _seeded(spark, sf_dir)
    after, _, before = unigram.measured_step(marked, model)
    return spark.createDataFrame([(round(before, 3), round(unigram.log_likelihood(marked, after), 3))], "before double, after double")


def unigram_prune(spark, sf_dir):
    marked, model = _seeded(spark, sf_dir)
    model, found = unigram.em_step(marked, model)
    model = unigram.pruned(model, found, 0.2)
    return spark.createDataFrame([(k, t, round(p, 6)) for k, (t, p) in enumerate(zip(model.vocab, model.log_probs, strict=True))], "token_id int, token string, log_prob double")


def _known(spark, sf_dir) -> tuple[DataFrame, unigram.Model]:
    """A model that lacks rare characters, and all pieces with them."""
    marked, model = _seeded(spark, sf_dir)
    often = {r["ch"] for r in counts.character_counts(marked, "s").where("c >= 200").collect()}  # an alphabet
    return marked, unigram.Model.uniform([t for t in model.vocab if often.issuperset(t)])


def unigram_fallback(spark, sf_dir):
    """Best paths where some characters are unknown: such sentences become single characters."""
    marked, model = _known(spark, sf_dir)
    return unigram.segmented(marked.select("s"), model, "s").select("s", _line("tokens").alias("tokens"), F.round("lp", 6).alias("lp"))


def unigram_known_counts(spark, sf_dir):
    """How often known pieces occur on these paths; unknown characters don't count."""
    return unigram.expected(*_known(spark, sf_dir))


def unigram_train(spark, sf_dir):
    """Learned from words as lines."""
    model = Unigram.train(_words(spark, sf_dir).withColumnRenamed("word", "sentence"), _UNI).model
    return spark.createDataFrame([(k, t, round(p, 6), model.protected(k)) for k, (t, p) in enumerate(zip(model.vocab, model.log_probs, strict=True))], "token_id int, token string, log_prob double, protected boolean")


def protected_tokens(spark, sf_dir):
    """Single words as tokens, and whether pruning may take them."""
    return _words(spark, sf_dir).select("word", T.is_protected("word").alias("protected"))


def top_tokens(spark, sf_dir):
    return bpe_token_frequencies(spark, sf_dir).orderBy(F.desc("c"), "token").limit(20)


def _numbered(lines: DataFrame) -> DataFrame:
    """The lines of a dump in their order."""
    return lines.sparkSession.createDataFrame([(k, r["value"]) for k, r in enumerate(lines.collect())], "line_no int, line string")


def dump_rules(spark, sf_dir):
    """The rules file of a model: left, tab, right."""
    return _numbered(models.rule_lines(spark, Bpe.train(_words(spark, sf_dir), _BPE)))


def dump_vocabulary(spark, sf_dir):
    """The vocabulary file of a sentence model, in id order."""
    return _numbered(models.vocab_lines(spark, SentenceBpe.train_marked(_placed_sentences(spark, sf_dir), _SP)))


def dump_log_probs(spark, sf_dir):
    """The vocabulary file of a unigram model: piece, tab, six places, sorted as lines."""
    return _numbered(models.vocab_lines(spark, Unigram(_seeded(spark, sf_dir)[1])))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_words, scan_sentences, scan_limit, pair_counts_top, pair_counts_all, wordpiece_pretokenize, wordpiece_token_counts, wordpiece_pair_scores,
        normalize_sentences, corpus_stats_words, corpus_stats_sentences, character_frequency, character_coverage, covered_sentences, first_seen_vocabulary,
        packed_pairs, seed_substrings, bpe_train, bpe_train_distributed, bpe_tokenize, bpe_token_frequencies, bpe_tokens_per_word, top_tokens, dump_rules, dump_vocabulary, dump_log_probs,
        sentence_bpe_train, sentence_bpe_vocabulary, sentence_bpe_frequencies, sentence_bpe_train_distributed, wordpiece_train, wordpiece_train_distributed, wordpiece_vocabulary, wordpiece_tokenize, wordpiece_frequencies,
        unigram_seed, unigram_tokenize, unigram_frequencies, unigram_em_step, unigram_log_likelihood, unigram_prune, unigram_fallback, unigram_known_counts, unigram_train, protected_tokens,
    )
}
