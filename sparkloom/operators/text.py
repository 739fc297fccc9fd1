"""Aggregates over text: statistics, n-gram frequencies, keyword counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_scaled
from ..functions.text import STOPWORDS, collapse, ngrams


def text_stats(df: DataFrame, key: str, name: str) -> DataFrame:
    """Words, characters, sentences and mean word length (2 decimals, 0 without words)."""
    rows = df.select(key, collapse(F.coalesce(name, F.lit(""))).alias("t"))
    words = F.filter(F.split("t", " "), lambda w: w != "")
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    sentences = F.filter(F.split("t", "[.!?]+"), lambda s: F.trim(s) != "")
    mean = F.when(F.size(words) > 0, letters / F.size(words)).otherwise(0.0)
    return rows.select(
        key, F.size(words).alias("word_count"), F.length("t").alias("char_count"),
        F.size(sentences).alias("sentence_count"), round_scaled(mean, 2).alias("avg_word_length"),
    )


def top_ngrams(df: DataFrame, label: str, tokens: Column, sizes: Sequence[int], k: int) -> DataFrame:
    """Per label and size the k most frequent n-grams, ties by text.

    All sizes share one scan; counts are combined before the shuffle and the ranking
    keeps k rows of each group before it sorts.
    """
    toks = df.select(label, tokens.alias("_t"))
    grams = F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col("_t"), n).alias("g")) for n in sizes])
    rows = toks.select(label, F.explode(grams).alias("s")).select(label, "s.n", F.explode("s.g").alias("gram"))
    freq = rows.groupBy(label, "n", "gram").agg(F.count("*").alias("freq"))
    rank = F.row_number().over(Window.partitionBy(label, "n").orderBy(F.desc("freq"), "gram"))
    return freq.withColumn("rank", rank).filter(F.col("rank") <= k)


def keyword_counts(df: DataFrame, name: str, keywords: Sequence[tuple[str, str]]) -> DataFrame:
    """Per (intent, keyword): rows that contain the keyword. One pass, whatever the number
    of keywords; a row counts once for each of its keywords."""
    low = F.lower(F.col(name))
    row = df.agg(*[F.count_if(low.contains(k)).alias(f"k{i}") for i, (_, k) in enumerate(keywords)])
    structs = [F.struct(F.lit(a).alias("intent"), F.lit(k).alias("keyword"), F.col(f"k{i}").alias("n")) for i, (a, k) in enumerate(keywords)]
    return row.select(F.inline(F.array(*structs)))


def corpus_stats(df: DataFrame, name: str) -> DataFrame:
    """One row: questions, mean lengths, stop words removed, vocabulary before and after."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    tokens = F.regexp_extract_all(F.lower(F.col(name)), F.lit("[a-z0-9']+"), 0)
    rows = df.select(F.col(name).alias("q"), tokens.alias("tok"))
    rows = rows.withColumn("kept", F.filter("tok", lambda w: ~F.array_contains(stop, w)))
    lengths = rows.agg(
        F.count("*").alias("questions"), F.round(F.avg(F.length("q")), 4).alias("avg_chars"),
        F.round(F.avg(F.size("tok")), 4).alias("avg_tokens"),
        F.round(F.avg(F.size("tok") - F.size("kept")), 4).alias("avg_stopwords"),
        (F.count("*") - F.count_distinct("q")).alias("duplicate_questions"),
    )
    words = rows.select(F.explode("tok").alias("w")).distinct()
    sizes = words.agg(
        F.count("*").alias("raw_vocabulary"), F.count_if(~F.array_contains(stop, F.col("w"))).alias("kept_vocabulary")
    )
    return lengths.crossJoin(sizes)


def value_frequencies(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per column and value (null is ''): kind, value, n and its share of the column. One scan."""
    each = F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in names])
    n = df.select(F.inline(each)).groupBy("kind", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6))
