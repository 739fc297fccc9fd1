"""TF-IDF in relational form: (item, term, weight) triples that join on terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams
from .ordering import dealt, parts_needed
from .quality import melt

#: Keys that a task counts, and entries of a table that it compares with another one.
KEY_ROWS = 500_000
#: Terms of a counted vocabulary that are broadcast at most, the most frequent ones.
COMMON_TERMS = 200_000


def terms(df: DataFrame, key: str, tokens: Column, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(key, term, tf) of the n-grams of all sizes.

    The tokens are a column of their own: inside the n-grams' lambda they would be made
    again for every place. Documents are dealt out by key before they become n-grams, which
    are many more: so their counts need no other shuffle, and a task has a bounded share.
    """
    rows = dealt(df, key).select(key, tokens.alias("_tokens"))
    grams = F.concat(*[ngrams(F.col("_tokens"), n) for n in sizes])
    return rows.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(
    df: DataFrame, key: str, tokens: Column, sizes: tuple[int, ...] = (1, 2), min_df: int = 2, max_df: float = 0.9,
    max_features: int | None = 20_000, sublinear: bool = True,
) -> DataFrame:
    """(key, term, weight): sublinear tf times ln((1 + N) / (1 + df)) + 1, of unit length.

    Terms in too few or too many documents are left out; of more than max_features the
    most counted stay, ties by term; None keeps every term.
    """
    known = vocabulary(df, key, tokens, sizes, min_df, max_df, max_features)
    return weighted(df, key, tokens, known, sizes, sublinear, max_features is not None)


def vocabulary(
    df: DataFrame, key: str, tokens: Column, sizes: tuple[int, ...] = (1, 2), min_df: int = 2, max_df: float = 0.9,
    max_features: int | None = 20_000,
) -> DataFrame:
    """(term, idf): what is learned from documents, and all that is needed to weigh others."""
    tf = terms(df, key, tokens, sizes)
    n = dealt(df.select(key), key, rows=KEY_ROWS).agg(F.count_distinct(key).alias("n_docs"))  # a split can hold very many keys
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return kept_terms(stats.crossJoin(F.broadcast(n)), F.col("n_docs"), min_df, max_df, max_features)


def kept_terms(stats: DataFrame, n_docs: Column, min_df: int, max_df: float, max_features: int | None) -> DataFrame:
    """(term, idf) of the terms that stay, of (term, df, total) and the number of documents."""
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= n_docs * max_df))
    if max_features is not None:
        kept = kept.orderBy(F.desc("total"), "term").limit(max_features)
    return kept.select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weighted(df: DataFrame, key: str, tokens: Column, known: DataFrame, sizes: tuple[int, ...] = (1, 2), sublinear: bool = True, small: bool = False) -> DataFrame:
    """(key, term, weight) of documents under a learned vocabulary; other terms are left out.

    small: the vocabulary has a bounded number of terms and is broadcast, so that documents
    stay where they are; a frequent term would take its documents to one task.
    """
    tf = terms(df, key, tokens, sizes)
    scaled = 1.0 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = tf.join(F.broadcast(known) if small else known, "term").select(key, "term", (scaled * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def with_known(tf: DataFrame, known: DataFrame, most: int = COMMON_TERMS) -> DataFrame:
    """tf with the columns of a saved vocabulary (term, df and others); other terms are left out.

    The vocabulary is counted. The most frequent terms are broadcast; if there are others, they
    meet their documents in a sorted join, where none of them is large. Documents are never
    broadcast: Spark takes highly compressed ones for less than the vocabulary.
    """
    if known.count() <= most:
        return tf.join(F.broadcast(known), "term")
    common = known.orderBy(F.desc("df"), "term").limit(most)
    met = tf.join(F.broadcast(common), "term")
    others = tf.join(F.broadcast(common.select("term")), "term", "left_anti")
    return met.unionByName(others.hint("merge").join(known, "term"))


def compared(df: DataFrame, key: str, tokens: Column, settings: Sequence[tuple[str, Sequence[str], int, float, bool]], folder: str) -> DataFrame:
    """(config, entries, terms, total weight) of TF-IDF of single words by each setting (name,
    words left out, min_df, max_df, sublinear); max_df is at most 1.

    Words are made and counted once for all settings, and their vocabulary is written to folder.
    """
    tf = terms(df, key, tokens, (1,))
    tf.groupBy("term").agg(F.count("*").alias("df")).write.parquet(folder)
    n = dealt(df.select(key), key, rows=KEY_ROWS).agg(F.count_distinct(key).alias("n_docs"))
    known = df.sparkSession.read.parquet(folder).crossJoin(F.broadcast(n))
    idf = F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0
    kept = [(F.col("df") >= low) & (F.col("df") <= F.col("n_docs") * high) & ~F.col("term").isin(*out) for _, out, low, high, _ in settings]
    known = known.select("term", "df", *[F.when(k, idf).alias(f"_idf{i}") for i, k in enumerate(kept)])
    count = F.col("tf").cast("double")
    weights = [F.col(f"_idf{i}") * (1.0 + F.log(count) if s[-1] else count) for i, s in enumerate(settings)]
    own = with_known(tf, known).select(key, *[w.alias(f"_w{i}") for i, w in enumerate(weights)])
    sums = []
    for i in range(len(settings)):
        w = F.col(f"_w{i}")
        sums += [F.count(w).alias(f"_n{i}"), (F.sum(w) / F.sqrt(F.sum(w * w))).alias(f"_unit{i}")]
    totals = [x for i in range(len(settings)) for x in (F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_n{i}"), F.round(F.sum(f"_unit{i}"), 3).alias(f"_unit{i}"))]
    one = own.groupBy(key).agg(*sums).agg(*totals)
    words = known.agg(*[F.count(f"_idf{i}").alias(f"_terms{i}") for i in range(len(settings))])  # a known term is in some document
    return melt(one.crossJoin(F.broadcast(words)), [(s[0], [F.col(f"_n{i}"), F.col(f"_terms{i}"), F.col(f"_unit{i}")]) for i, s in enumerate(settings)], ["config", "entries", "terms", "total"])


def save(known: DataFrame, triples: DataFrame, base: str) -> None:
    """The learned vocabulary and the weights as Parquet."""
    known.write.mode("overwrite").parquet(f"{base}/vocabulary")
    triples.write.mode("overwrite").parquet(f"{base}/triples")


def load(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, triples) as saved."""
    return spark.read.parquet(f"{base}/vocabulary"), spark.read.parquet(f"{base}/triples")


def norms(triples: DataFrame, key: str) -> DataFrame:
    """Per item the length of its vector and whether it is unit length."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    return triples.groupBy(key).agg(length.alias("norm")).withColumn("is_unit", F.abs(F.col("norm") - 1) <= 1e-3)


def largest_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: entries of either table, and the largest difference of their weights.

    The entries of a are counted to cut both tables into bounded parts, so a should be a
    saved one. Entries that a table repeats are summed, and count as often; null keys are equal.
    """
    x = a.select(key, "term", F.col("weight").alias("gap"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    y = b.select(key, "term", (-F.col("weight")).alias("gap"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    rows = x.unionByName(y).repartition(parts_needed(a, rows=KEY_ROWS), key, "term")
    met = rows.groupBy(key, "term").agg(*[F.sum(c).alias(c) for c in ("gap", "in_a", "in_b")])
    entries, largest = F.sum(F.greatest("in_a", "in_b")), F.max(F.abs(F.col("gap")))
    return met.agg(F.coalesce(entries, F.lit(0)).alias("entries"), F.coalesce(largest, F.lit(0.0)).alias("largest"))


def content_documents(items: DataFrame, tags: DataFrame, key: str, title: Column, genres: Column) -> DataFrame:
    """Per item: content (title, genre and tag words), num_genres, num_tags.

    tags has one row for each tagged item: key, tags (joined), num_tags; items without
    any have none. The pseudo genre counts as no genre.
    """
    joined = items.join(tags, key, "left")
    none = F.array_contains(genres, "(none)")
    words = F.array(title, F.when(~none, F.array_join(genres, " ")), F.coalesce("tags", F.lit("")))
    kept = F.filter(words, lambda w: F.coalesce(F.trim(w), F.lit("")) != "")
    return joined.select(
        key, F.array_join(kept, " ").alias("content"), F.when(none, 0).otherwise(F.size(genres)).alias("num_genres"),
        F.coalesce("num_tags", F.lit(0)).alias("num_tags"),
    )
