"""python -m lexweave bpe|wordpiece|sentence|unigram --file F [--dump D] [--tokenize TEXT] [--runs N] ..."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import counts
from .operators.models import Bpe, BpeConfig, SentenceBpe, SentenceBpeConfig, Unigram, UnigramConfig, WordPiece, WordPieceConfig
from .plans import models
from .plans.tables import written
from .sources import text_files


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexweave")
    kinds = top.add_subparsers(dest="kind", required=True)
    for kind in ("bpe", "wordpiece", "sentence", "unigram"):
        p = kinds.add_parser(kind)
        p.add_argument("--file", required=True)
        p.add_argument("--runs", type=int, default=5)
        p.add_argument("--tokenize")
        p.add_argument("--dump-rules" if kind == "bpe" else "--dump-vocab", dest="dump")
        p.add_argument("--save")
        p.add_argument("--max-words" if kind in ("bpe", "wordpiece") else "--max-lines", dest="limit", type=int)
        if kind != "unigram":
            p.add_argument("--min-pair", type=int, default=2)
        if kind == "bpe":
            p.add_argument("--merges", type=int, default=25)
        else:
            p.add_argument("--vocab-size", type=int, default=1000)
        if kind == "wordpiece":
            p.add_argument("--top-tokens", type=int, default=0)
        if kind == "sentence":
            p.add_argument("--coverage", type=float, default=0.9995)
        if kind == "unigram":
            p.add_argument("--vocab-factor", type=float, default=10.0)
            p.add_argument("--em-iters", type=int, default=5)
            p.add_argument("--prune-ratio", type=float, default=0.2)
    return top


def _train(a: argparse.Namespace, rows):
    if a.kind == "bpe":
        return Bpe.train(rows, BpeConfig(a.merges, a.min_pair))
    if a.kind == "wordpiece":
        return WordPiece.train(rows, WordPieceConfig(a.vocab_size, a.min_pair))
    if a.kind == "sentence":
        return SentenceBpe.train(rows, SentenceBpeConfig(a.vocab_size, a.coverage, a.min_pair))
    return Unigram.train(rows, UnigramConfig(a.vocab_size, a.vocab_factor, a.em_iters, a.prune_ratio))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexweave").getOrCreate()
    column = "word" if a.kind in ("bpe", "wordpiece") else "sentence"
    try:
        load = text_files.load_words if column == "word" else text_files.load_sentences
        rows = written(text_files.histogram(load(spark, a.file, a.limit), column, "place" if a.kind == "wordpiece" else None))
    except Exception as error:  # an unreadable or empty file, or bytes that are no text
        print(f"cannot read {a.file}: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1
    if a.dump or a.tokenize is not None or a.save:  # dump comes before tokenize, tokenize before timing
        model = _train(a, rows)
        if a.save:
            models.save(spark, model, a.save)
        if a.dump:
            models.dump(models.rule_lines(spark, model) if a.kind == "bpe" else models.vocab_lines(spark, model), a.dump)
        elif a.tokenize is not None:
            one = spark.createDataFrame([(a.tokenize,)], f"{column} string")
            print("[" + ", ".join('"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"' for t in model.segmented(one, column).first()["tokens"]) + "]")
        return 0
    stats = counts.corpus_stats(rows, column).first()
    print(f"rows {stats['n_rows']}, characters {stats['n_chars']}" + (f", mean {stats['mean_chars']:.2f}" if column == "word" else ""))
    took = []
    for _ in range(max(1, a.runs)):
        began = time.perf_counter()
        model = _train(a, rows)
        took.append((time.perf_counter() - began) * 1000)
    mean = sum(took) / len(took)
    print(f"ms: min {min(took):.1f}, mean {mean:.1f}, max {max(took):.1f}; {stats['n_rows'] / mean * 1000:.0f} rows/s")
    if getattr(a, "top_tokens", 0):
        for r in model.frequencies(rows).orderBy(F.desc("c"), "token").limit(a.top_tokens).collect():
            print(f"{r['token']}\t{r['c']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
