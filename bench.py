"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators.models import Bpe, BpeConfig, SentenceBpe, SentenceBpeConfig, Unigram, UnigramConfig, WordPiece, WordPieceConfig
from lexweave.sources import text_files as S

SF, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = S.histogram(S.words_of(docs), "word")
    sentences = words.withColumnRenamed("word", "sentence")  # words as lines, as in the baseline
    few = words.orderBy("word").limit(5000).withColumnRenamed("word", "sentence")  # as many lines as the baseline's
    runs = {
        "histogram": lambda: words.agg(F.sum("n")).first(),
        "pair_counts": lambda: words.select(F.explode(T.adjacent(T.characters("word"))).alias("p"), "n").groupBy("p.l", "p.r").agg(F.sum("n")).count(),
        "bpe_train_450": lambda: Bpe.train(words, BpeConfig(450, 2)),
        "wordpiece_train_500": lambda: WordPiece.train(words, WordPieceConfig(500, 2)),
        "sentence_bpe_train_500": lambda: SentenceBpe.train(sentences, SentenceBpeConfig(500, 0.9995, 2)),
        "unigram_train_500": lambda: Unigram.train(few, UnigramConfig(500, 10.0, 3, 0.2)),
    }
    # over tables, as histograms beyond the compact bounds are
    pieces = words.select(F.explode(T.continuation_pieces("word")).alias("t")).distinct().count()
    lines = words.withColumnRenamed("word", "sentence")
    apart = {
        "bpe_train_450_distributed": lambda: Bpe.train(words, BpeConfig(450, 2), compact_symbols=0),
        "wordpiece_train_320_distributed": lambda: WordPiece.train(words, WordPieceConfig(pieces + 320, 2), compact_symbols=0),
        "sentence_bpe_train_60_distributed": lambda: SentenceBpe.train(sentences, SentenceBpeConfig(len(SentenceBpe.alphabet(sentences, 0.9995)) + 61, 0.9995, 2), compact_symbols=0),
        "unigram_train_500_all_words": lambda: Unigram.train(lines, UnigramConfig(500, 2.0, 1, 0.2)),
    }
    took = {}
    for name, run in (runs | apart).items():
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "tokenizer_training_total", "value": round(sum(took[k] for k in runs), 3), "unit": "sec", "queries": took, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
