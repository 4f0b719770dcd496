"""The four tokenizers: learning, applying, token frequencies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..plans.tables import written
from . import counts, merges, segment, unigram

def stored(rows: DataFrame) -> DataFrame:
    """Rows that are read several times, written unless they come from written()."""
    return rows if hasattr(rows, "written_to") else written(rows)


def _fields(rows: DataFrame, column: str) -> list[str]:
    """The fields of a struct, in order, or the column itself."""
    kind = rows.schema[column].dataType
    return [f"{column}.`{f.name}`" for f in kind.fields] if isinstance(kind, StructType) else [column]


#: With more rules than this, replaying them is done in batches and not as column expressions.
COLUMN_RULES = 512


@dataclass(frozen=True)
class BpeConfig:
    num_merges: int = 25
    min_pair_count: int = 2


@dataclass(frozen=True)
class WordPieceConfig:
    vocab_size: int = 1000
    min_pair_count: int = 2


@dataclass(frozen=True)
class SentenceBpeConfig:
    vocab_size: int = 1000
    character_coverage: float = 0.9995
    min_pair_count: int = 2


@dataclass(frozen=True)
class UnigramConfig:
    target_vocab_size: int = 1000
    initial_vocab_factor: float = 10.0
    em_iterations: int = 5
    prune_ratio: float = 0.2


@dataclass
class Bpe:
    """Byte-pair merges inside words. words: (word, n)."""

    rules: list[tuple[str, str, str]]

    @staticmethod
    def train(words: DataFrame, config: BpeConfig | None = None, **how) -> Bpe:
        config, words = config or BpeConfig(), stored(words)
        texts = words.select(F.col("word").alias("s"), "n")
        return Bpe(merges.learn(texts, start=merges.Start(), least=config.min_pair_count, done=lambda rules, _: rules >= config.num_merges, **how))

    def tokenize(self, word: Column | str) -> Column:
        """Rules replayed in order, one pass each; characters never seen pass through."""
        return T.tokens_of(T.applied_rules(T.held(T.characters(word)), self.rules))

    def segmented(self, rows: DataFrame, column: str = "word") -> DataFrame:
        """The rows with `tokens` beside them: the same tokens, also where the rules are many."""
        if len(self.rules) <= COLUMN_RULES:
            return rows.withColumn("tokens", self.tokenize(column))
        shared = rows.sparkSession.sparkContext.broadcast(self.rules)

        def make():
            replay = segment.Replay(shared.value)
            return segment.each(lambda word: replay(list(word)))

        return segment.segmented(rows, column, make)

    def frequencies(self, words: DataFrame) -> DataFrame:
        return merges.frequencies(words.where("word <> ''").select(F.col("word").alias("s"), "n"), merges.Start(), self.rules)


@dataclass
class WordPiece:
    """Likelihood-ratio merges; greedy longest match."""

    vocab: list[str]
    rules: list[tuple[str, str, str]]

    @staticmethod
    def train(words: DataFrame, config: WordPieceConfig | None = None, **how) -> WordPiece:
        """The vocabulary lists the base pieces, then merges in the order they came. With a column `first`
        in words (where each stands first) base pieces are numbered by first occurrence, else by bytes."""
        config, words, start = config or WordPieceConfig(), stored(words), merges.Start(continues=True)
        texts = words.select(F.col("word").alias("s"), "n")
        if "first" in words.columns:  # at most twice the alphabet
            seen = counts.first_characters(words, "word", _fields(words, "first"), pieces=True)
            seeds = [r["token"] for r in counts.first_seen_ids(seen).orderBy("token_id").collect()]
        else:
            seeds = sorted(r["token"] for r in merges.first_tokens(texts, start).collect())
        rules = merges.learn(texts, start=start, by_score=True, least=config.min_pair_count, done=lambda _, size: size >= config.vocab_size, join=merges.continued, seeds=seeds, **how)
        return WordPiece(list(dict.fromkeys([*seeds, *(m for _, _, m in rules)])), rules)

    def segmented(self, rows: DataFrame, column: str = "word") -> DataFrame:
        """The rows with `tokens` beside them: at each place the longest piece in the vocabulary; a dead end
        makes the whole word [UNK]. The vocabulary is as small as its configured size."""
        shared = rows.sparkSession.sparkContext.broadcast(self.vocab)
        return segment.segmented(rows, column, lambda: segment.Greedy(shared.value))

    def tokenize(self, words: DataFrame) -> DataFrame:
        """(word, tokens) of distinct words."""
        return self.segmented(words.select("word").distinct())

    def frequencies(self, words: DataFrame) -> DataFrame:
        return counts.token_counts(self.segmented(words.where("word <> ''").select("word", "n")).select("tokens", "n"))


@dataclass
class SentenceBpe:
    """Byte-pair merges over marked sentences, across word boundaries too."""

    vocab: list[str]
    rules: list[tuple[str, str, str]]

    @staticmethod
    def marked(sentences: DataFrame) -> DataFrame:
        """(s, n) of sentences (sentence, n), and `first` if they have it."""
        first = [F.col("first")] if "first" in sentences.columns else []
        return sentences.select(T.marked_sentence("sentence").alias("s"), "n", *first).where("s <> ''")

    @staticmethod
    def alphabet(sentences: DataFrame, coverage: float) -> list[str]:
        return SentenceBpe._covered(SentenceBpe.marked(sentences), coverage)

    @staticmethod
    def _covered(marked: DataFrame, coverage: float) -> list[str]:
        return [r["ch"] for r in counts.coverage_cut(counts.character_counts(marked, "s"), coverage).orderBy(F.desc("c"), "ch").collect()]

    @staticmethod
    def train(sentences: DataFrame, config: SentenceBpeConfig | None = None, **how) -> SentenceBpe:
        """The vocabulary lists <unk>, the covered characters, then merges in order. With a column `first` in
        sentences (where each stands first) characters are numbered by first occurrence, else by frequency."""
        return SentenceBpe.train_marked(SentenceBpe.marked(sentences), config, **how)

    @staticmethod
    def train_marked(marked: DataFrame, config: SentenceBpeConfig | None = None, **how) -> SentenceBpe:
        """The same from what marked() gives."""
        config, marked = config or SentenceBpeConfig(), stored(marked)
        chars = SentenceBpe._covered(marked, config.character_coverage)
        start = merges.Start(known=tuple(chars))
        if "first" in marked.columns:
            seen = counts.first_seen_ids(counts.first_characters(marked, "s", _fields(marked, "first")))
            chars = [r["token"] for r in seen.where(F.col("token").isin(chars)).orderBy("token_id").collect()]  # an alphabet
        seeds = [T.UNK, *chars]
        rules = merges.learn(marked.select("s", "n"), start=start, least=config.min_pair_count, done=lambda _, size: size >= config.vocab_size, seeds=seeds, **how)
        return SentenceBpe(list(dict.fromkeys([*seeds, *(m for _, _, m in rules)])), rules)

    def tokenize(self, sentence: Column | str) -> Column:
        single = [t for t in self.vocab if len(t) == 1]
        return T.tokens_of(T.applied_rules(T.held(T.covered(T.characters(T.marked_sentence(sentence)), single)), self.rules))

    def segmented(self, rows: DataFrame, column: str = "sentence") -> DataFrame:
        """The rows with `tokens` beside them: the same tokens, also where the rules are many."""
        if len(self.rules) <= COLUMN_RULES:
            return rows.withColumn("tokens", self.tokenize(column))
        known = {t for t in self.vocab if len(t) == 1}
        shared = rows.sparkSession.sparkContext.broadcast((self.rules, known))

        def make():
            rules, known = shared.value
            replay = segment.Replay(rules)
            return segment.each(lambda marked: replay([c if c in known else T.UNK for c in marked]))

        names = [c for c in rows.columns if c != "tokens"]
        return segment.segmented(rows.withColumn("__s", T.marked_sentence(column)), "__s", make).select(*[F.col(f"`{c}`") for c in names], "tokens")

    def frequencies(self, sentences: DataFrame) -> DataFrame:
        return self.frequencies_marked(SentenceBpe.marked(sentences))

    def frequencies_marked(self, marked: DataFrame) -> DataFrame:
        """The same from what marked() gives."""
        single = tuple(t for t in self.vocab if len(t) == 1)
        return merges.frequencies(marked.select("s", "n"), merges.Start(known=single), self.rules)


@dataclass
class Unigram:
    """Probabilistic pieces, pruned between EM rounds; Viterbi segmentation."""

    model: unigram.Model
    sizes: list[int] = field(default_factory=list)

    @staticmethod
    def train(sentences: DataFrame, config: UnigramConfig | None = None) -> Unigram:
        config = config or UnigramConfig()
        marked = sentences.select(T.marked_sentence("sentence").alias("s"), "n").where("s <> ''").groupBy("s").agg(F.sum("n").alias("n"))
        model, sizes = unigram.train(marked, config.target_vocab_size, config.initial_vocab_factor, config.em_iterations, config.prune_ratio)
        return Unigram(model, sizes)

    def segmented(self, rows: DataFrame, column: str = "sentence") -> DataFrame:
        """The rows with `tokens` beside them."""
        return unigram.segmented(rows.withColumn("__s", T.marked_sentence(column)), self.model, "__s").drop("__s", "lp")

    def tokenize(self, sentences: DataFrame, column: str = "sentence") -> DataFrame:
        return self.segmented(sentences, column)

    def frequencies(self, sentences: DataFrame) -> DataFrame:
        return self.frequencies_marked(SentenceBpe.marked(sentences))

    def frequencies_marked(self, marked: DataFrame) -> DataFrame:
        """The same from marked sentences (s, n); unknown characters count too."""
        return unigram.token_sums(marked, self.model)
