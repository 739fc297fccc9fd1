"""Substring search over an index of grams, and joins with a table of keywords.

Nothing here compares every text with every needle: needles and texts meet on grams that
both have, and what meets is verified literally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import parts_needed

#: Length of the longest gram of the index, the parts of the index that a task makes, and the most needles that are broadcast.
GRAM, TASK_PARTS, FEW = 3, 16, 10_000


def _characters(text: Column) -> Column:
    """The code points of a text as an array; places in an array are found at once."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _windows(characters: Column, size: int | Column) -> Column:
    """The substrings of so many characters from every place; shorter at the end."""
    every = F.when(F.size(characters) > 0, F.sequence(F.lit(1), F.size(characters))).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda i: F.array_join(F.slice(characters, i, size if isinstance(size, Column) else F.lit(size)), ""))


def grams(characters: Column) -> Column:
    """Distinct grams of one to three characters of a text, by the array of its characters.

    That should be a plain column, since it is read again at every place.
    """
    three = _windows(characters, GRAM)
    two = F.transform(three, lambda g: F.substring(g, 1, 2))
    return F.array_distinct(F.concat(three, two, characters))


def write_gram_index(df: DataFrame, key: str, text: str, folder: str) -> None:
    """(part, gram, keys): the keys of the texts of a part that hold a gram. Null texts have none.

    Rows are dealt out to parts by key, and a part is indexed where it lies, so that no gram
    is shuffled and a frequent one has a row in every part. Files are ordered by gram: a
    search reads the row groups of its grams only.
    """
    texts = df.filter(F.col(text).isNotNull()).select(key, F.lower(text).alias("_text"))
    tasks = parts_needed(texts)
    part = F.pmod(F.xxhash64(key), F.lit(tasks * TASK_PARTS)).alias("part")
    rows = texts.select(part, key, "_text").repartition(tasks, "part").select("part", key, _characters(F.col("_text")).alias("_chars"))
    found = rows.select("part", key, F.explode(grams(F.col("_chars"))).alias("gram"))
    lists = found.groupBy("part", "gram").agg(F.collect_list(key).alias("keys"))
    lists.sortWithinPartitions("gram", "part").write.mode("overwrite").parquet(folder)


def _wanted(needle: Column) -> Column:
    """The grams that a text must have to hold the needle: its trigrams, or itself if it is shorter."""
    long = F.filter(_windows(_characters(needle), GRAM), lambda g: F.char_length(g) == GRAM)
    return F.array_distinct(F.when(F.char_length(needle) < GRAM, F.array(needle)).otherwise(long))


def search(df: DataFrame, key: str, text: str, folder: str, needle: str) -> DataFrame:
    """Rows whose text contains the needle in any case, by the index; an empty needle is in every text that is not null."""
    found = df.sparkSession.range(1).select(F.lower(F.lit(needle)).alias("needle"))
    if not needle:
        return df.filter(F.col(text).isNotNull())
    hits = search_all(df, key, text, folder, found)
    return hits.select(*df.columns)


def search_all(df: DataFrame, key: str, text: str, folder: str, needles: DataFrame) -> DataFrame:
    """(needle, columns of df) of every text that contains a needle of a table in any case.

    key: names a row of df. In each part the lists of the needle's grams are intersected; what
    holds them all is verified. Empty needles find nothing.
    """
    spark = df.sparkSession
    asked = needles.select(F.lower("needle").alias("needle")).filter("needle <> ''").distinct()
    wanted = asked.select("needle", F.size(_wanted(F.col("needle"))).alias("_need"), F.explode(_wanted(F.col("needle"))).alias("gram"))
    if asked.count() <= FEW:  # so that a frequent gram does not take its lists to one task
        wanted = F.broadcast(wanted)
    lists = spark.read.parquet(folder).join(wanted, "gram").groupBy("part", "needle", "_need").agg(F.collect_list("keys").alias("_lists"))
    whole = lists.filter(F.size("_lists") == F.col("_need"))
    common = F.aggregate(F.slice("_lists", 2, F.size("_lists")), F.array_distinct(F.get("_lists", 0)), F.array_intersect)
    met = whole.select("needle", F.explode(common).alias(key))
    rows = df.join(met, key)
    return rows.filter(F.contains(F.lower(text), F.col("needle"))).select("needle", *df.columns)


def _class(length: Column) -> Column:
    """The largest power of two that is not above a length."""
    return F.pow(F.lit(2), F.floor(F.log2(length))).cast("int")


def keyword_matches(df: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """(keyword, key, place) of every place (from 1) at which a keyword of a table stands in a text.

    Both sides are lower-cased. Keywords are put into classes by the largest power of two in
    their length; they meet texts on their first characters, so many as the class says, and
    the rest is compared. The classes are those that occur, a few in one row.
    """
    words = keywords.select(F.lower("keyword").alias("keyword")).filter("keyword <> ''").distinct()
    words = words.withColumn("_c", _class(F.char_length("keyword")))
    words = words.withColumn("_seed", F.substring("keyword", F.lit(1), F.col("_c")))
    classes = words.agg(F.collect_set("_c").alias("_classes"))
    texts = df.filter(F.col(text).isNotNull()).select(F.col(key), _characters(F.lower(text)).alias("_chars"))
    by_class = texts.crossJoin(F.broadcast(classes)).select(key, "_chars", F.explode("_classes").alias("_c"))  # one row
    places = by_class.select(key, "_c", F.posexplode(_windows(F.col("_chars"), F.col("_c") * 2 - 1)).alias("_at", "_window"))
    places = places.withColumn("_seed", F.substring("_window", F.lit(1), F.col("_c")))
    met = places.join(words, ["_c", "_seed"]).filter(F.startswith("_window", F.col("keyword")))
    return met.select("keyword", key, (F.col("_at") + 1).alias("place"))
