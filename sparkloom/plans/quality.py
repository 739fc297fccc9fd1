"""Queries on data quality and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp
from ..operators import quality as Q
from ..operators.ordering import quantiles, with_position
from .registry import Tables, query

_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    f"""select count(*)::bigint as n_rows, 11 as n_columns,
    ({' + '.join(f'count_if({c} is null)' for c in _LINE)})::bigint as null_cells,
    (count(*) - (select count(*) from (select distinct * from lineitem)))::bigint as duplicate_rows from lineitem"""
)
def profile_lineitem(t: Tables) -> DataFrame:
    return Q.profile(t.lineitem)


def _events_with_gaps(t: Tables) -> DataFrame:
    """events with some values, types and users missing or blank."""
    e = t.events
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 11 == 0, F.lit("  ")).when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("user_id"),
    )


_GAPS = """gaps as (select event_id, case when event_id % 7 <> 0 then value end as value,
  case when event_id % 11 = 0 then '  ' when event_id % 13 = 0 then null else event_type end as event_type,
  case when event_id % 17 <> 0 then user_id end as user_id from events)"""


def _each(names: tuple[str, ...], select: str) -> str:
    return " union all ".join(select.format(c=c) for c in names)


@query(
    f"with {_GAPS} "
    + _each(("event_id", "value", "event_type", "user_id"), "select '{c}' as column_name, count_if({c} is null)::bigint as missing, round(count_if({c} is null) * 100.0::double / count(*), 4) as pct from gaps")
)
def missing_report(t: Tables) -> DataFrame:
    return Q.missing_report(_events_with_gaps(t))


_COUNTED = ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")


@query(_each(_COUNTED, "select '{c}' as column_name, count(distinct {c})::bigint as n_distinct from lineitem"))
def distinct_counts(t: Tables) -> DataFrame:
    return Q.distinct_counts(t.lineitem, _COUNTED)


@query("""select l_orderkey, l_linenumber, (count(*) - 1)::bigint as extra from lineitem
  group by l_orderkey, l_linenumber having count(*) > 1""")
def duplicate_keys(t: Tables) -> DataFrame:
    return Q.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_orderkey, l_linenumber) > 1 as is_duplicate
  from lineitem""")
def duplicate_flag_all(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return Q.flag_duplicates(rows, ["l_orderkey", "l_linenumber"])


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (
  select *, row_number() over (partition by l_orderkey, l_linenumber
    order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) as nth from lineitem) where nth = 1""")
def dedup_keep_first(t: Tables) -> DataFrame:
    """The first row of each key, in an order that leaves no ties."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    values = F.struct(*order)
    first = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(values).alias("f"))
    return first.select("l_orderkey", "l_linenumber", "f.l_partkey", "f.l_suppkey", "f.l_quantity")


@query("""select p_partkey, p_name from (select p_partkey, p_name, count(*) over (partition by p_name) as n from part) where n > 1""")
def repeated_names(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_name")
    return Q.flag_duplicates(rows, ["p_name"]).filter("is_duplicate").drop("is_duplicate")


_RELATIONS = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("documents", "doc_id", "labels", "doc_id"),
    ("labels", "doc_id", "documents", "doc_id"),
)


@query(
    " union all ".join(
        f"""select '{c}.{ck} -> {p}' as relation, count(*)::bigint as child_rows,
        count_if({ck} is null or {ck} not in (select {pk} from {p} where {pk} is not null))::bigint as orphans,
        round(count_if({ck} is null or {ck} not in (select {pk} from {p} where {pk} is not null)) * 100.0::double / count(*), 4) as pct from {c}"""
        for c, ck, p, pk in _RELATIONS
    )
)
def fk_orphans(t: Tables) -> DataFrame:
    parts = [Q.orphans(getattr(t, c), getattr(t, p), ck, pk, f"{c}.{ck} -> {p}") for c, ck, p, pk in _RELATIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select doc_id, lang, source from documents where doc_id not in (select doc_id from labels)")
def anti_unlabelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("select doc_id, lang, source from documents where doc_id in (select doc_id from labels)")
def semi_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id"), "doc_id", "left_semi")


@query("""select count(*)::bigint as total, count_if(not (l_discount between 0.01 and 0.08))::bigint as out_of_range,
  count_if(l_discount between 0.01 and 0.08 and not ok)::bigint as off_grid,
  count_if(l_discount between 0.01 and 0.08 and ok)::bigint as valid from (
    select l_discount, abs((l_discount - 0.01) / 0.02 - round_even((l_discount - 0.01) / 0.02, 0))
      <= 1e-8 + 1e-5 * abs(round_even((l_discount - 0.01) / 0.02, 0)) as ok from lineitem)""")
def domain_grid_check(t: Tables) -> DataFrame:
    return Q.grid_check(t.lineitem, "l_discount", 0.01, 0.08, 0.02)


@query(
    _each(("o_orderkey", "o_custkey", "o_totalprice"), "select '{c}' as column_name, count_if({c} is null)::bigint as missing, count_if({c} < 0)::bigint as negative, count_if({c} % 1 <> 0)::bigint as non_integer from orders")
)
def id_checks(t: Tables) -> DataFrame:
    return Q.id_checks(t.orders, ["o_orderkey", "o_custkey", "o_totalprice"])


@query(f"with {_GAPS} select 'event_type' as column_name, count_if(event_type is null)::bigint as null_cells, count_if(trim(event_type) = '')::bigint as blank_cells from gaps")
def null_blank_cells(t: Tables) -> DataFrame:
    return Q.null_or_blank_cells(_events_with_gaps(t))


@query("select * from (values ('c_comment', 'missing'), ('c_acctbal', 'extra'), ('c_mktsegment', 'extra'), ('c_nationkey', 'extra')) v(column_name, problem)")
def schema_check(t: Tables) -> DataFrame:
    return Q.schema_check(t.customer, ["c_custkey", "c_name", "c_comment"])


def _quality_checks(t: Tables) -> DataFrame:
    return Q.checks(
        t.orders,
        {
            "not_empty": F.count("*") > 0,
            "ids_present": F.count_if(F.col("o_orderkey").isNull()) == 0,
            "ids_not_negative": F.count_if(F.col("o_orderkey") < 0) == 0,
            "ids_unique": F.count_distinct("o_orderkey") == F.count("*"),
            "prices_positive": F.min("o_totalprice") > 0,
            "few_statuses": F.count_distinct("o_orderstatus") <= 2,
        },
    )


_CHECKS = """checks as (select unnest([
  {'check_name': 'not_empty', 'passed': n > 0}, {'check_name': 'ids_present', 'passed': nulls = 0},
  {'check_name': 'ids_not_negative', 'passed': neg = 0}, {'check_name': 'ids_unique', 'passed': ids = n},
  {'check_name': 'prices_positive', 'passed': low > 0}, {'check_name': 'few_statuses', 'passed': st <= 2}], recursive := true)
 from (select count(*) n, count_if(o_orderkey is null) nulls, count_if(o_orderkey < 0) neg, count(distinct o_orderkey) ids,
  min(o_totalprice) low, count(distinct o_orderstatus) st from orders))"""


@query(f"with {_CHECKS} select check_name, passed from checks")
def integrity_checks(t: Tables) -> DataFrame:
    return _quality_checks(t)


@query(f"with {_CHECKS} select case when bool_and(passed) then 'PASS' else 'FAIL' end as status, count_if(not passed)::bigint as failed from checks")
def quality_gate(t: Tables) -> DataFrame:
    return Q.gate(_quality_checks(t))


@query(f"""with {_GAPS}, ruled as (select *, case when value is null then 'null_value' when event_type is null or trim(event_type) = '' then 'blank_type'
    when user_id is null then 'null_user' when not (value between 5 and 450) then 'out_of_range' end as r from gaps),
  judged as (select coalesce(r, case when row_number() over (partition by r is null, user_id, event_type order by event_id) > 1 then 'duplicate' else 'kept' end) as rule from ruled),
  steps as (select * from (values (1, 'null_value'), (2, 'blank_type'), (3, 'null_user'), (4, 'out_of_range'), (5, 'duplicate')) s(step, rule)),
  removed as (select step, s.rule, (select count(*) from judged j where j.rule = s.rule)::bigint as removed from steps s)
  select step, rule, removed, ((select count(*) from judged) - sum(removed) over (order by step))::bigint as retained from removed""")
def clean_rule_log(t: Tables) -> DataFrame:
    """What each cleaning rule removes, in order; duplicates are judged on survivors."""
    rules = [
        ("null_value", F.col("value").isNull()),
        ("blank_type", F.col("event_type").isNull() | (F.trim("event_type") == "")),
        ("null_user", F.col("user_id").isNull()),
        ("out_of_range", ~F.col("value").between(5, 450)),
    ]
    judged = Q.first_failing_rule(_events_with_gaps(t), rules, ["user_id", "event_type"], [F.col("event_id")])
    return Q.rule_log(judged, [n for n, _ in rules])


@query(f"""with {_GAPS}, filled as (select *, nullif(trim(event_type), '') as kind from gaps),
  m as (select quantile_cont(value, 0.5) as med, (select kind from filled where kind is not null group by kind order by count(*) desc, kind limit 1) as mode from filled)
  select event_id, round(coalesce(value, med), 6) as value, coalesce(kind, mode) as event_type from filled, m""")
def impute_median_mode(t: Tables) -> DataFrame:
    """Missing numbers become the median, missing or blank categories the lowest mode."""
    rows = _events_with_gaps(t).withColumn("kind", F.nullif(F.trim("event_type"), F.lit("")))
    kinds = rows.filter("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))
    mode = kinds.agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("mode"))
    one = quantiles(rows, F.col("value"), {"med": 0.5}).crossJoin(F.broadcast(mode))
    return rows.crossJoin(F.broadcast(one)).select(
        "event_id", F.round(F.coalesce("value", "med"), 6).alias("value"), F.coalesce("kind", "mode").alias("event_type")
    )


@query(f"""with {_GAPS} select event_id, case when value < 50 then 50.0 when value > 200 then 200.0 else value end::double as value,
  coalesce(value < 50 or value > 200, false) as clamped from gaps""")
def clamp_rows(t: Tables) -> DataFrame:
    v = F.col("value")
    beyond = F.coalesce((v < 50) | (v > 200), F.lit(False))
    return _events_with_gaps(t).select("event_id", clamp(v, 50.0, 200.0).alias("value"), beyond.alias("clamped"))


@query(f"with {_GAPS} select count_if(value < 50)::bigint as below, count_if(value > 200)::bigint as above, count(value)::bigint as present from gaps")
def clamp_counts(t: Tables) -> DataFrame:
    v = F.col("value")
    return _events_with_gaps(t).agg(
        F.count_if(v < 50).alias("below"), F.count_if(v > 200).alias("above"), F.count(v).alias("present")
    )


@query(f"with {_GAPS} select event_id, value, user_id from gaps where value is not null and user_id is not null")
def drop_null_rows(t: Tables) -> DataFrame:
    return _events_with_gaps(t).select("event_id", "value", "user_id").na.drop(subset=["value", "user_id"])


@query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_rows(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("select s_suppkey, (row_number() over (order by s_suppkey) - 1)::int as row_index from supplier")
def dense_index(t: Tables) -> DataFrame:
    """Contiguous places over the sorted ids."""
    placed = with_position(t.supplier.select("s_suppkey"), ["s_suppkey"], "place")
    return placed.select("s_suppkey", (F.col("place") - 1).cast("int").alias("row_index"))


_LANGS = ("de", "en", "es", "fr", "xx")


@query(f"""with r as (select trim(coalesce(lang, '')) as said, trim(coalesce(text, ''), ' ') = '' as blank from documents),
  c as (select w, (select count(*) from r where said = w) as n from (select unnest({list(_LANGS)}) as w)),
  o as (select count(*) as n, count_if(blank) as blank, count_if(said = '') as unlabelled, count_if(said <> '' and said not in {_LANGS}) as unknown from r),
  s as (select count_if(n < 150) as small, max(n)::double / min(nullif(n, 0)) as ratio from c),
  k as (select 'rows' as check_name, 'error' as level, n::double as observed, n >= 500 as passed from o union all select 'blank_texts', 'error', blank, blank = 0 from o
    union all select 'blank_labels', 'error', unlabelled, unlabelled = 0 from o union all select 'unknown_labels', 'error', unknown, unknown = 0 from o
    union all select 'small_classes', 'error', small, small = 0 from s union all select 'imbalance', 'warning', round(ratio, 6), coalesce(ratio <= 3, false) from s)
  select * from k union all select 'is_valid', 'result', count_if(level = 'error' and not passed)::double, count_if(level = 'error' and not passed) = 0 from k""")
def dataset_gate(t: Tables) -> DataFrame:
    """Whether the documents are fit to learn languages from."""
    return Q.dataset_gate(t.documents, "text", "lang", _LANGS, 500, 150, 3.0)
