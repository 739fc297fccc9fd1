"""Temporal splits and ranking metrics for all users and all K in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temporal_split(df: DataFrame, user: str, time: str, item: str, share: float = 0.2, least: int = 1) -> DataFrame:
    """df with is_test: the newest max(least, round(n * share)) rows of each user.

    Rounding is half to even; at least one row of each user stays for training; the
    later of equal times is the one with the larger item.
    """
    per = Window.partitionBy(user)
    n = F.count("*").over(per)
    from_end = F.row_number().over(per.orderBy(F.desc(time), F.desc(item))) - 1
    size = F.greatest(F.least(F.greatest(F.lit(least), F.rint(n * share).cast("long")), n - 1), F.lit(0))
    return df.withColumn("is_test", from_end < size)


def eligible_users(train: DataFrame, user: str, least: int, most: int, seed: int = 42) -> DataFrame:
    """At most so many users with enough training rows, chosen by a hash of their id."""
    n = train.groupBy(user).agg(F.count("*").alias("n_train")).filter(F.col("n_train") >= least)
    return n.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(user).cast("string"))), user).limit(most)


def skip_counts(liked: DataFrame, relevant: DataFrame, every: DataFrame, user: str) -> DataFrame:
    """One row: users, those without_history (nothing liked), without_relevant (else), and evaluated."""
    a = liked.select(user).distinct().withColumn("_liked", F.lit(True))
    b = relevant.select(user).distinct().withColumn("_relevant", F.lit(True))
    users = every.select(user).distinct().join(a, user, "left").join(b, user, "left")
    some, any_ = F.col("_liked").isNotNull(), F.col("_relevant").isNotNull()
    return users.agg(
        F.count("*").alias("users"), F.count_if(~some).alias("without_history"), F.count_if(some & ~any_).alias("without_relevant"),
        F.count_if(some & any_).alias("evaluated"),
    )


def ranking_metrics(recs: DataFrame, relevant: DataFrame, user: str, item: str, ks: Sequence[int]) -> DataFrame:
    """Per K the means over users of precision, recall, hit, ap and ndcg.

    recs: user, item, rank. Repeated items of a user count once, at their first rank.
    relevant: distinct user, item. Users are those of either table; precision divides
    by the items recommended, ap by min(relevant, K); users without any score 0.
    """
    first = recs.groupBy(user, item).agg(F.min("rank").alias("rank"))
    pos = F.row_number().over(Window.partitionBy(user).orderBy("rank", item))
    ranked = first.withColumn("pos", pos).filter(F.col("pos") <= max(ks))
    hits = ranked.join(relevant.select(user, item).withColumn("hit", F.lit(1)), [user, item], "left")
    shown = [F.count_if(F.col("pos") <= k).alias(f"n{k}") for k in ks]
    found = _hits(hits.filter("hit = 1"), user, ks)
    sizes = relevant.groupBy(user).agg(F.count("*").alias("g"))
    per = ranked.groupBy(user).agg(*shown).join(found, user, "left").join(sizes, user, "full_outer")
    return _means(per, ks)


def shared_list_metrics(
    listed: DataFrame, judged: DataFrame, relevant: Column, user: str, item: str, ks: Sequence[int]
) -> DataFrame:
    """ranking_metrics where every user is shown the same list, in one pass over the judged rows.

    listed: item, rank; at most max(ks) rows of it are used, and broadcast. judged: distinct
    user, item, of all users who are shown it; relevant tells which rows count. The table is
    grouped by user once, without a shuffle where it is already partitioned so, and a user
    carries at most max(ks) places.
    """
    first = listed.groupBy(item).agg(F.min("rank").alias("rank"))
    top = first.orderBy("rank", item).limit(max(ks))
    top = top.withColumn("pos", F.row_number().over(Window.partitionBy().orderBy("rank", item))).select(item, "pos")
    shown = top.agg(*[F.count_if(F.col("pos") <= k).alias(f"n{k}") for k in ks])
    rows = judged.select(user, item, F.coalesce(relevant, F.lit(False)).alias("_good"))
    met = rows.join(F.broadcast(top), item, "left").groupBy(user).agg(
        F.count_if("_good").alias("g"), F.sort_array(F.collect_set(F.when(F.col("_good"), F.col("pos")))).alias("_at")
    )
    per = [user, "g"]
    for k in ks:
        at = _upto("_at", k)
        precisions = F.transform(at, lambda p, i: (i + 1) / p)
        gains = F.transform(at, lambda p: 1 / F.log2(p + 1.0))
        per += [F.size(at).alias(f"h{k}"), _sum(precisions).alias(f"a{k}"), _sum(gains).alias(f"d{k}")]
    return _means(met.select(*per).crossJoin(F.broadcast(shown)), ks)


def _upto(values: str, k: int) -> Column:
    return F.filter(values, lambda v: v <= k)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _hits(met: DataFrame, user: str, ks: Sequence[int]) -> DataFrame:
    """Per user and K, from the places of hits: how many, the sum of precisions there, the discounted sum."""
    upto = Window.partitionBy(user).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("cum", F.count("*").over(upto))
    aggs = []
    for k in ks:
        at = F.col("pos") <= k
        aggs += [
            F.count_if(at).alias(f"h{k}"), F.sum(F.when(at, F.col("cum") / F.col("pos"))).alias(f"a{k}"),
            F.sum(F.when(at, 1 / F.log2(F.col("pos") + 1.0))).alias(f"d{k}"),
        ]
    return met.groupBy(user).agg(*aggs)


def _means(per: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Means over users from n, h, a and d of each K and g, the number of relevant items; null is 0."""
    per = per.na.fill(0)
    rows = []
    for k in ks:
        n, h, a, d = (F.col(f"{x}{k}") for x in "nhad")
        best = F.least(F.col("g"), F.lit(k)).cast("int")
        terms = F.when(best > 0, F.sequence(F.lit(1), F.greatest(best, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        ideal = F.aggregate(terms, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        rows.append(F.struct(
            F.lit(k).alias("k"), F.coalesce(h / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("precision"),
            F.coalesce(h / F.nullif(F.col("g"), F.lit(0)), F.lit(0.0)).alias("recall"), (h > 0).cast("double").alias("hit"),
            F.coalesce(a / F.nullif(best, F.lit(0)), F.lit(0.0)).alias("ap"),
            F.coalesce(d / F.nullif(ideal, F.lit(0.0)), F.lit(0.0)).alias("ndcg"),
        ))
    long = per.select(F.inline(F.array(*rows)))
    means = [F.round(F.avg(m), 6).alias(m) for m in ("precision", "recall", "hit", "ap", "ndcg")]
    return long.groupBy("k").agg(F.count("*").alias("users"), *means)
