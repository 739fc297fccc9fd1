"""Queries that check what other queries make: features, recommendations, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_tokens, normalize_text, split_values
from ..operators import crud as C
from ..operators import quality as Q
from ..operators import similarity as SM
from ..operators import stats as S
from ..operators.tfidf import content_documents as content
from ..operators.tfidf import largest_difference, load, norms, save, vocabulary, weighted
from ..sources import versions
from ..sources.sinks import with_header
from ..streaming.carried import carry_on, means
from .registry import Tables, query
from .retrieval import _SEEDS, _TFIDF, _popular, _triples


@query("""with p as (select user_id as p_partkey, lower(trim(event_type)) || '-' || (event_id % 4) as tag, count(*) as n from events where event_type is not null group by 1, 2),
  f as (select tag, sum(n) as freq from p group by 1), g as (select p_partkey, string_agg(tag, ' ' order by freq desc, tag) as tags, count(*) as k from p join f using (tag) group by 1)
  select p_partkey, lower(p_name) || case when p_partkey % 5 = 0 then '' else ' ' || p_type || ' ' || p_brand end || coalesce(' ' || tags, '') as content,
  case when p_partkey % 5 = 0 then 0 else 2 end as num_genres, coalesce(k, 0)::int as num_tags from part left join g using (p_partkey)""")
def content_documents(t: Tables) -> DataFrame:
    """Titles, genres and tags of each item as one text; what is missing is left out."""
    tag = F.expr("lower(trim(event_type)) || '-' || (event_id % 4)")
    tags = S.ordered_concat(t.events.withColumnRenamed("user_id", "p_partkey"), "p_partkey", tag)
    genres = split_values(F.when(F.col("p_partkey") % 5 != 0, F.concat_ws("|", "p_type", "p_brand")))
    return content(t.part, tags, "p_partkey", normalize_text(F.col("p_name")), genres)


@query(f"""with {_TFIDF}, n as (select id, sqrt(sum(weight * weight)) as norm from triples group by 1)
  select unnest([{{'check_name': 'not_empty', 'passed': (select count(*) from triples) > 0}}, {{'check_name': 'finite', 'passed': (select count_if(not isfinite(weight)) from triples) = 0}},
  {{'check_name': 'not_negative', 'passed': (select min(weight) from triples) >= 0}}, {{'check_name': 'unit_length', 'passed': (select max(abs(norm - 1)) from n) <= 1e-6}},
  {{'check_name': 'few_terms', 'passed': (select count(distinct term) from triples) <= 20000}}, {{'check_name': 'entries_once', 'passed': (select count(*) from (select distinct id, term from triples)) = (select count(*) from triples)}},
  {{'check_name': 'all_items', 'passed': (select count(distinct id) from triples) = (select count(*) from part)}}], recursive := true)""")
def tfidf_checks(t: Tables) -> DataFrame:
    triples = _triples(t)
    w = F.col("weight")
    entries = triples.groupBy("p_partkey", "term").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
    first = Q.checks(
        entries,
        {
            "not_empty": F.count("*") > 0, "finite": F.count_if(F.isnan(w) | (F.abs(w) == float("inf"))) == 0,
            "not_negative": F.min(w) >= 0, "few_terms": F.count_distinct("term") <= 20_000, "entries_once": F.max("n") == 1,
        },
    )
    items = t.part.select("p_partkey").join(norms(triples, "p_partkey"), "p_partkey", "left")
    second = Q.checks(items, {"unit_length": F.max(F.abs(F.col("norm") - 1)) <= 1e-6, "all_items": F.count_if(F.col("norm").isNull()) == 0})
    return first.unionByName(second)


@query(f"with {_TFIDF} select count(*)::bigint as entries, 0.0::double as largest from triples")
def tfidf_reproduces(t: Tables) -> DataFrame:
    """Features saved and read back are those that the saved vocabulary gives anew."""
    parts, base = t.part.select("p_partkey", "p_name", "p_type", "p_brand"), t.scratch("features")
    tokens = normal_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    known = vocabulary(parts, "p_partkey", tokens)
    save(known, weighted(parts, "p_partkey", tokens, known, small=True), base)
    known, triples = load(t.spark, base)
    again = weighted(parts, "p_partkey", tokens, known, small=True)
    return largest_difference(triples, again, "p_partkey").withColumn("largest", F.round("largest", 9))


@query(f"""with {_TFIDF}, {_SEEDS}, pairs as (select seed, i.p_partkey as id from seeds, part i where i.p_partkey <> seed),
  met as (select q.id as seed, t.id, sum(q.weight * t.weight) as s from triples q join triples t using (term) where q.id in (select seed from seeds) group by 1, 2),
  sc as (select p.seed, p.id, round(coalesce(s, 0), 6) as score from pairs p left join met using (seed, id)),
  rk as (select *, row_number() over (partition by seed order by score desc, id)::int as rank from sc),
  w as (select *, lag(score) over (partition by seed order by rank) as before, row_number() over (partition by seed order by rank) as place,
    count(*) over (partition by seed, id) as times, id in (select p_partkey from part) as known from rk where rank <= 10)
  select 'ranks_contiguous' as check_name, count_if(rank <> place) = 0 as passed from w union all select 'no_self', count_if(seed = id) = 0 from w
  union all select 'scores_in_range', count_if(score not between 0 and 1 + 1e-9) = 0 from w union all select 'scores_descend', count_if(score > before) = 0 from w
  union all select 'items_once', max(times) = 1 from w union all select 'items_known', count_if(not known) = 0 from w""")
def recommendation_checks(t: Tables) -> DataFrame:
    """What has to hold of the recommendations of the three most rated items."""
    recs = SM.similar_items(_triples(t), "p_partkey", _popular(t, 3), 10)
    by_seed = Window.partitionBy("seed").orderBy("rank")
    rows = recs.withColumns(
        {"before": F.lag("score").over(by_seed), "place": F.row_number().over(by_seed), "times": F.count("*").over(Window.partitionBy("seed", "p_partkey"))}
    )
    known = t.part.select("p_partkey", F.lit(True).alias("known"))
    return Q.checks(
        rows.join(known, "p_partkey", "left"),
        {
            "ranks_contiguous": F.count_if(F.col("rank") != F.col("place")) == 0, "no_self": F.count_if(F.col("seed") == F.col("p_partkey")) == 0,
            "scores_in_range": F.count_if(~F.col("score").between(0, 1 + 1e-9)) == 0, "scores_descend": F.count_if(F.col("score") > F.col("before")) == 0,
            "items_once": F.max("times") == 1, "items_known": F.count_if(F.col("known").isNull()) == 0,
        },
    )


@query("""select '{"headers":["r_regionkey","r_name"]}' as value union all select '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' from region""")
def json_with_header(t: Tables) -> DataFrame:
    return with_header(t.region.select("r_regionkey", "r_name")).select("value")


@query("select s_suppkey, case when n = 4 then 'Renamed' else s_name end as s_name from (select *, row_number() over (order by s_name, s_suppkey) as n from supplier)")
def update_by_position(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_name")
    return C.update_by_position(rows, ["s_name", "s_suppkey"], 4, {"s_name": F.lit("Renamed"), "nothing": F.lit(1)})


@query("""select s_suppkey, s_name, case when n = 6 then 12.5 else s_acctbal end as s_acctbal, cast(null as varchar) as errors from (select *, row_number() over (order by s_name, s_suppkey) as n from supplier)
  union all select s_suppkey, '', -10000.0, 'balance below the limit, name missing' from (select *, row_number() over (order by s_name, s_suppkey) as n from supplier) where n = 4""")
def update_revalidated(t: Tables) -> DataFrame:
    """A change by place that is refused with its errors, and one that is made."""
    errors = F.filter(F.array(F.when(F.col("s_acctbal") < -999.99, "balance below the limit"), F.when(F.trim("s_name") == "", "name missing")), lambda e: e.isNotNull())
    rows, order = t.supplier.select("s_suppkey", "s_name", "s_acctbal"), ["s_name", "s_suppkey"]
    rows, refused = C.update_validated(rows, order, 4, {"s_acctbal": F.lit(-10_000.0), "s_name": F.lit("")}, errors)
    rows, none = C.update_validated(rows, order, 6, {"s_acctbal": F.lit(12.5)}, errors)
    said = refused.unionByName(none).withColumn("errors", F.array_join("errors", ", "))
    return rows.withColumn("errors", F.lit(None).cast("string")).unionByName(said)


@query("""select 1 as version, count(*)::bigint as n, round(sum(c_acctbal), 2) as balance from customer
  union all select 2, count(*)::bigint, round(sum(case when c_acctbal < 0 then 0 else c_acctbal end), 2) from customer where c_mktsegment is not null
  union all select 3, count(*)::bigint, round(sum(c_acctbal), 2) from customer""")
def replaced_by_pointer(t: Tables) -> DataFrame:
    """A table, what replaced it, and the first one restored, as readers found them."""
    base = t.scratch("versions")
    versions.replace(t.customer, base)
    better = versions.current(t.spark, base).filter("c_mktsegment is not null").withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    versions.replace(better, base)
    versions.restore(t.spark, base, 1)
    parts = [versions.current(t.spark, base, n).select(F.lit(n).alias("version"), "c_acctbal") for n in (1, 2, 3)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("version").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("select event_type, count(*)::bigint as rating_count, round(avg(value), 6) as mean_rating from events group by 1")
def carried_counts(t: Tables) -> DataFrame:
    """Counts and means of events that arrive in four files, merged batch by batch into a stored table."""
    base = t.scratch("carried")
    t.events.select("event_type", "value", "event_id").repartition(4, "event_id").write.parquet(f"{base}/in")
    kinds = t.spark.read.parquet(f"{base}/in").schema
    for _ in range(2):  # the second run finds nothing new
        stream = t.spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        carry_on(stream, f"{base}/out", "event_type", "value", f"{base}/checkpoint").awaitTermination()
    return means(versions.current(t.spark, f"{base}/out"), "event_type").withColumn("mean_rating", F.round("mean_rating", 6))
