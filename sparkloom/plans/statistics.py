"""Queries on descriptive statistics and popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_values
from ..operators import stats as S
from ..operators.ordering import column_quantiles
from .registry import Tables, query


@query("""with s as (select l_partkey, count(*)::bigint as rating_count, avg(l_quantity) as m from lineitem group by l_partkey),
  top as (select * from s order by rating_count desc, m desc, l_partkey limit 100)
  select row_number() over (order by rating_count desc, m desc, l_partkey)::int as rank, l_partkey, p_name, rating_count, round(m, 6) as mean_rating
  from top left join part on p_partkey = l_partkey where rating_count >= (select least(50, min(rating_count)) from s)""")
def popularity_top(t: Tables) -> DataFrame:
    """The 100 most rated items by count, mean and id, with names. The threshold that
    comes after is the smaller of 50 and the least count, so it removes nothing."""
    stats = S.popularity(t.lineitem, "l_partkey", "l_quantity")
    order = [F.desc("rating_count"), F.desc("mean_rating"), F.col("l_partkey")]
    least = stats.agg(F.least(F.lit(50), F.min("rating_count")).alias("least"))
    top = stats.orderBy(*order).limit(100).crossJoin(least).filter("rating_count >= least")
    named = top.join(t.part.select("p_partkey", "p_name"), top["l_partkey"] == F.col("p_partkey"), "left")
    rank = F.row_number().over(Window.orderBy(*order))
    return named.select(rank.alias("rank"), "l_partkey", "p_name", "rating_count", F.round("mean_rating", 6).alias("mean_rating"))


@query("select l_partkey, count(*)::bigint as rating_count, round(avg(l_quantity), 6) as mean_rating from lineitem group by l_partkey")
def popularity_stats(t: Tables) -> DataFrame:
    return S.popularity(t.lineitem, "l_partkey", "l_quantity").withColumn("mean_rating", F.round("mean_rating", 6))


@query("""select count(l_quantity)::bigint as n, min(l_quantity) as min, max(l_quantity) as max, round(avg(l_quantity), 4) as mean,
  round(quantile_cont(l_quantity, 0.5), 4) as median, round(stddev_samp(l_quantity), 4) as std from lineitem""")
def rating_summary(t: Tables) -> DataFrame:
    return S.summary(t.lineitem, "l_quantity")


@query("""select g::int as grid, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) * 100.0::double / (select count(*) from lineitem), 3) as pct
  from range(0, 56) r(g) left join (select l_quantity::int as q, count(*) as n from lineitem group by 1) on q = g""")
def grid_distribution(t: Tables) -> DataFrame:
    return S.grid_distribution(t.lineitem, F.col("l_quantity"), 0, 55)


@query("""with per as (select o_custkey, count(*)::double as n from orders where o_custkey is not null group by 1),
  one as (select count(*)::bigint as n_keys, min(n) as min, max(n) as max, round(avg(n), 4) as mean, quantile_cont(n, 0.5) as median,
    quantile_cont(n, 0.01) as p01, quantile_cont(n, 0.99) as p99 from per)
  select one.*, (select count_if(n >= p99) from per)::bigint as heavy, (select count_if(n <= p01) from per)::bigint as light from one""")
def user_activity_percentiles(t: Tables) -> DataFrame:
    return S.activity(t.orders, "o_custkey")


@query("select o_custkey, count(*)::bigint as n from orders where o_custkey is not null group by 1")
def user_counts(t: Tables) -> DataFrame:
    return t.orders.filter("o_custkey is not null").groupBy("o_custkey").agg(F.count("*").alias("n"))


def _tokens() -> Column:
    return split_values(F.concat_ws("|", F.regexp_replace("p_name", " ", "|"), "p_type"))


@query("""with v as (select unnest(list_distinct(string_split(replace(p_name, ' ', '|') || '|' || p_type, '|'))) as value from part)
  select value, count(*)::bigint as n, round(count(*) * 100.0::double / (select count(*) from part), 3) as pct from v group by 1""")
def category_explode_counts(t: Tables) -> DataFrame:
    return S.exploded_counts(t.part, F.array_distinct(_tokens()), "(none)")


_HOT = ("small", "large", "red", "blue", "ring")


@query("select p_partkey, " + ", ".join(f"list_contains(string_split(replace(p_name, ' ', '|') || '|' || p_type, '|'), '{v}')::int as is_{v}" for v in _HOT) + " from part")
def multi_hot(t: Tables) -> DataFrame:
    return S.multi_hot(t.part, "p_partkey", _tokens(), _HOT)


@query("""select count(*)::bigint as n_rows, count(distinct user_id)::bigint as users, count(distinct date_trunc('day', ts))::bigint as days,
  count(distinct lower(trim(event_type)))::bigint as tags from events""")
def tag_stats(t: Tables) -> DataFrame:
    return t.events.agg(
        F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("users"),
        F.count_distinct(F.date_trunc("day", "ts")).alias("days"), F.count_distinct(F.lower(F.trim("event_type"))).alias("tags"),
    )


@query("""select event_type as tag, count(*)::bigint as n from events where event_type is not null group by 1 order by 2 desc, 1 limit 3""")
def tag_top(t: Tables) -> DataFrame:
    n = t.events.filter("event_type is not null").groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "tag").limit(3)


_TAG = "lower(trim(event_type)) || '-' || (event_id % 9)"


@query(f"""with p as (select user_id, {_TAG} as tag from events where event_type is not null)
  select count(*)::bigint as valid_rows, count(distinct tag)::bigint as unique_tags,
  round((select count(*) from (select distinct user_id, tag from p)) * 1.0::double / count(distinct user_id), 6) as avg_per_user from p""")
def tag_stats_normalised(t: Tables) -> DataFrame:
    tags = t.events.filter("event_type is not null").select("user_id", F.expr(_TAG).alias("tag"))
    pairs = tags.groupBy("user_id", "tag").agg(F.count("*").alias("n"))
    per = pairs.groupBy("user_id").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    one = per.agg(F.sum("n").alias("valid_rows"), (F.sum("k") / F.count("*")).alias("a"))
    return one.crossJoin(pairs.agg(F.count_distinct("tag").alias("unique_tags"))).select(
        "valid_rows", "unique_tags", F.round("a", 6).alias("avg_per_user")
    )


@query(f"""with p as (select user_id, {_TAG} as tag, count(*) as n from events where event_type is not null group by 1, 2),
  f as (select tag, sum(n) as freq from p group by 1)
  select user_id, string_agg(tag, ' ' order by freq desc, tag) as tags, count(*)::int as num_tags from p join f using (tag) group by 1""")
def ordered_tag_concat(t: Tables) -> DataFrame:
    return S.ordered_concat(t.events, "user_id", F.expr(_TAG))


@query("""select event_type, round(avg(value), 2) as value_mean, round(quantile_cont(value, 0.5), 2) as value_median, round(stddev_samp(value), 2) as value_std,
  round(avg(user_id), 2) as user_mean, round(quantile_cont(user_id::double, 0.5), 2) as user_median, round(stddev_samp(user_id), 2) as user_std
  from events where event_type is not null group by 1""")
def group_multi_agg(t: Tables) -> DataFrame:
    rows, aggs = t.events.filter("event_type is not null"), []
    numbers = {"value": F.col("value").cast("double"), "user": F.col("user_id").cast("double")}
    for n, d in numbers.items():
        aggs += [F.round(F.avg(d), 2).alias(f"{n}_mean"), F.round(F.stddev_samp(d), 2).alias(f"{n}_std")]
    middles = column_quantiles(rows, numbers, {"median": 0.5}, ["event_type"])
    out = rows.groupBy("event_type").agg(*aggs).join(middles, "event_type", "left")
    return out.withColumns({f"{n}_median": F.round(f"{n}_median", 2) for n in numbers})


@query("select o_orderpriority, count(*)::bigint as n, round(count(*)::double / sum(count(*)) over (), 4) as share from orders where o_orderpriority is not null group by 1")
def value_share(t: Tables) -> DataFrame:
    return S.value_share(t.orders, "o_orderpriority")


@query("select c_mktsegment, round(avg(c_acctbal), 4) as mean_balance, row_number() over (order by avg(c_acctbal) desc, c_mktsegment)::int as rank from customer where c_mktsegment is not null group by 1")
def group_mean(t: Tables) -> DataFrame:
    m = t.customer.filter("c_mktsegment is not null").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"))
    rank = F.row_number().over(Window.orderBy(F.desc("m"), "c_mktsegment"))
    return m.select("c_mktsegment", F.round("m", 4).alias("mean_balance"), rank.alias("rank"))


@query("select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month, round(avg(o_totalprice), 4) as mean_price from orders group by 1")
def monthly_mean(t: Tables) -> DataFrame:
    month = F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd")
    return t.orders.groupBy(month.alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""select 'day' as period, strftime(ts, '%Y-%m-%d') as start, count(*)::bigint as n from events group by 2
  union all select 'month', strftime(ts, '%Y-%m'), count(*)::bigint from events group by 2
  union all select 'year', strftime(ts, '%Y'), count(*)::bigint from events group by 2""")
def volume_by_period(t: Tables) -> DataFrame:
    """Rows by day, month and year from one aggregation by day."""
    days = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.count("*").alias("n"))
    parts = F.array(*[F.struct(F.lit(p).alias("period"), F.substring("d", 1, k).alias("start")) for p, k in (("day", 10), ("month", 7), ("year", 4))])
    return days.select(F.explode(parts).alias("p"), "n").groupBy("p.period", "p.start").agg(F.sum("n").alias("n"))


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" union all ".join(f"select '{c}' as column_name, round(skewness({c}), 6) as skewness, round(kurtosis({c}), 6) as kurtosis from lineitem" for c in _NUMERIC))
def moments_corrected(t: Tables) -> DataFrame:
    return S.moments(t.lineitem, _NUMERIC)


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]))
def corr_matrix(t: Tables) -> DataFrame:
    return S.correlations(t.lineitem, _NUMERIC)


_FEATURES = ("l_quantity", "l_discount", "l_tax")


@query("with c as (" + " union all ".join(f"select '{c}' as feature, round(corr({c}, l_extendedprice), 6) as r from lineitem" for c in _FEATURES) + """)
  select feature, r, case when abs(r) >= 0.5 then 'Strong' when abs(r) >= 0.3 then 'Moderate' else 'Weak' end as strength,
  case when r >= 0 then 'Positive' else 'Negative' end as sign, row_number() over (order by abs(r) desc, feature)::int as rank from c""")
def corr_rank(t: Tables) -> DataFrame:
    return S.correlation_ranking(t.lineitem, "l_extendedprice", _FEATURES)


@query("""with q as (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders),
  f as (select *, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from q)
  select round(any_value(q1), 6) as q1, round(any_value(q3), 6) as q3, round(any_value(low), 6) as low, round(any_value(high), 6) as high,
  count_if(o_totalprice < low)::bigint as below, count_if(o_totalprice > high)::bigint as above,
  round(count_if(o_totalprice < low or o_totalprice > high) * 100.0::double / count(o_totalprice), 4) as pct from orders, f""")
def iqr_outliers(t: Tables) -> DataFrame:
    return S.iqr_outliers(t.orders, "o_totalprice")


@query("""with e as (select min(value) as low, max(value) as high from events)
  select least(floor((value - low) / (high - low) * 50) + 1, 50)::int as bin, count(*)::bigint as n from events, e where value is not null group by 1""")
def histogram50(t: Tables) -> DataFrame:
    return S.histogram(t.events, "value", 50)


@query("""select quality, min(n_chars)::double as min, quantile_cont(n_chars::double, 0.25) as q1, quantile_cont(n_chars::double, 0.5) as median,
  quantile_cont(n_chars::double, 0.75) as q3, max(n_chars)::double as max from documents join labels using (doc_id) group by 1""")
def five_number_by_label(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return S.five_numbers(joined, "quality", "n_chars")


@query("""select count(*)::bigint as classes, min(n)::bigint as min_size, max(n)::bigint as max_size, round(min(n)::double / max(n), 6) as ratio,
  count_if(n < 120)::bigint as below from (select lang, count(*) as n from documents where lang is not null group by 1)""")
def class_balance(t: Tables) -> DataFrame:
    return S.class_balance(t.documents, "lang", 120)


@query("select round(avg(toxic), 6) as toxic_share, round(avg(quality), 6) as quality_share from labels")
def share_true(t: Tables) -> DataFrame:
    return t.labels.agg(F.round(F.avg("toxic"), 6).alias("toxic_share"), F.round(F.avg("quality"), 6).alias("quality_share"))


@query("select event_type, array_to_string(list(event_id order by event_id)[1:4], ',') as first_ids from events where event_type is not null group by 1")
def first_n_per_group(t: Tables) -> DataFrame:
    """The first four of each group: found before they are gathered."""
    nth = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    rows = t.events.filter("event_type is not null").select("event_type", "event_id", nth.alias("nth")).filter("nth <= 4")
    return rows.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("first_ids"))


@query("""select event_id, year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, hour(ts)::int as hour, dayname(ts) as weekday from events""")
def datetime_features(t: Tables) -> DataFrame:
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}
    weekday = F.date_format("ts", "EEEE")
    return t.events.select("event_id", *[f("ts").alias(n) for n, f in parts.items()], weekday.alias("weekday"))
