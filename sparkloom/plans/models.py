"""Queries on models and their metrics, record validation and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import validate as V
from ..functions.numeric import sigmoid
from ..operators import crud as C
from ..operators import metrics as M
from ..operators import models as ML
from ..operators.ordering import dealt_in_order
from ..sources.sinks import as_json, newest
from .registry import Tables, query

# -- regression


@query("select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem")
def regression_simple(t: Tables) -> DataFrame:
    one = M.simple_regression(t.lineitem, "l_extendedprice", "l_quantity")
    return one.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


_FITTED = """m as (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i, avg(l_extendedprice) as mean from lineitem),
  p as (select l_extendedprice as y, s * l_quantity + i as p, mean from lineitem, m)"""


def _fitted(t: Tables) -> DataFrame:
    line = t.lineitem.select("l_extendedprice", "l_quantity")
    one = M.simple_regression(line, "l_extendedprice", "l_quantity")
    return line.crossJoin(F.broadcast(one)).select("l_extendedprice", (F.col("slope") * F.col("l_quantity") + F.col("intercept")).alias("p"))


@query(f"with {_FITTED} select count(*)::bigint as n, round(avg(abs(y - p)), 3) as mae, round(avg((y - p) ** 2) / 1e6, 3) as mse_millions, round(sqrt(avg((y - p) ** 2)), 3) as rmse, round(1 - sum((y - p) ** 2) / sum((y - mean) ** 2), 6) as r2 from p")
def regression_metrics(t: Tables) -> DataFrame:
    one = M.regression_metrics(_fitted(t), "l_extendedprice", "p", 9)
    return one.select("n", F.round("mae", 3).alias("mae"), F.round(F.col("mse") / 1e6, 3).alias("mse_millions"), F.round("rmse", 3).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(f"with {_FITTED} select abs(round(avg(y - p), 3)) as mean, round(stddev_samp(y - p), 3) as std, round(min(y - p), 3) as min, round(max(y - p), 3) as max, round(skewness(y - p), 3) as skewness, round(kurtosis(y - p), 3) as kurtosis from p")
def residual_stats(t: Tables) -> DataFrame:
    out = M.residual_stats(_fitted(t), F.col("l_extendedprice") - F.col("p"), 3)
    return out.withColumn("mean", F.abs("mean"))


@query(f"with {_FITTED} select abs(round(avg(p), 4)) as mean, round(stddev_samp(p), 4) as std, round(min(p), 4) as min, round(max(p), 4) as max from p")
def prediction_report(t: Tables) -> DataFrame:
    p = F.col("p")
    return _fitted(t).agg(F.abs(F.round(F.avg(p), 4)).alias("mean"), F.round(F.stddev_samp(p), 4).alias("std"), F.round(F.min(p), 4).alias("min"), F.round(F.max(p), 4).alias("max"))


# -- classification

_SCORED = "b as (select doc_id, quality, 1 / (1 + exp(-((n_chars - 1500) / 1000.0::double))) as score from documents join labels using (doc_id))"


def _scored(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return joined.select("doc_id", "quality", sigmoid((F.col("n_chars") - 1500) / F.lit(1000.0)).alias("score"))


@query(f"""with {_SCORED}, c as (select count_if(quality = 1 and score >= 0.5) as tp, count_if(quality = 0 and score >= 0.5) as fp,
  count_if(quality = 1 and score < 0.5) as fn, count_if(quality = 0 and score < 0.5) as tn from b)
  select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy,
  round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c""")
def binary_metrics(t: Tables) -> DataFrame:
    said = (F.col("score") >= 0.5).cast("int")
    return M.binary_metrics(_scored(t), F.col("quality"), said)


@query(f"""with {_SCORED}, r as (select quality, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as rk from b)
  select round((sum(case when quality = 1 then rk end) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2) / (count_if(quality = 1) * count_if(quality = 0)), 6) as auc from r""")
def roc_auc(t: Tables) -> DataFrame:
    return M.roc_auc(_scored(t), F.col("quality"), F.col("score"))


_GUESS = """g as (select doc_id, lang, case when contains(lower(text), ' und ') then 'de' when contains(lower(text), ' que ') then 'es'
  when contains(lower(text), ' les ') or contains(lower(text), ' le ') then 'fr' else 'en' end as said from documents)"""


def _guessed(t: Tables) -> DataFrame:
    low = F.lower("text")
    said = F.when(low.contains(" und "), "de").when(low.contains(" que "), "es")
    said = said.when(low.contains(" les ") | low.contains(" le "), "fr").otherwise("en")
    return t.documents.select("doc_id", "lang", said.alias("said"))


_PER = f"""{_GUESS}, l as (select lang as label from g union select said from g),
  per as (select label, (select count(*) from g where lang = label)::bigint as support, (select count(*) from g where said = label) as n_said,
    (select count(*) from g where said = label and lang = label) as hit from l),
  rep as (select label, support, coalesce(hit / nullif(n_said, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall, coalesce(2 * hit / nullif(n_said + support, 0), 0) as f1 from per)"""


@query(f"with {_PER} select label, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from rep")
def class_report(t: Tables) -> DataFrame:
    return M.class_report(_guessed(t), "lang", "said")


@query(f"""with {_PER} select round(sum(recall * support) / sum(support), 6) as accuracy, round(avg(precision), 6) as precision_macro, round(sum(precision * support) / sum(support), 6) as precision_weighted,
  round(avg(recall), 6) as recall_macro, round(sum(recall * support) / sum(support), 6) as recall_weighted, round(avg(f1), 6) as f1_macro, round(sum(f1 * support) / sum(support), 6) as f1_weighted from rep""")
def multiclass_metrics(t: Tables) -> DataFrame:
    return M.multiclass_metrics(_guessed(t), "lang", "said")


@query(f"with {_GUESS} select lang, said, count(*)::bigint as n from g where lang <> said group by 1, 2 order by 3 desc, 1, 2 limit 10")
def confusion_pairs(t: Tables) -> DataFrame:
    return M.confusion_pairs(_guessed(t), "lang", "said")


@query(f"with {_GUESS} select lang, said, count(*)::bigint as n from g group by 1, 2")
def confusion_matrix(t: Tables) -> DataFrame:
    return M.confusion(_guessed(t), "lang", "said")


@query(f"with {_GUESS} select doc_id, lang, said from g where lang <> said")
def error_rows(t: Tables) -> DataFrame:
    return _guessed(t).filter("lang <> said")


@query("select doc_id, lang, ((row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) - 1) % 5)::int as fold from documents")
def fold_assign(t: Tables) -> DataFrame:
    return M.stratified_fold(t.documents.select("doc_id", "lang"), "lang", "doc_id", 5)


@query("select o_orderkey, ('0x' || substr(md5('42:' || o_orderkey), 1, 12))::bigint / 281474976710656.0::double < 0.2 as is_test from orders")
def train_test_split(t: Tables) -> DataFrame:
    train, test = ML.hash_split(t.orders.select("o_orderkey"), F.col("o_orderkey"))
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("""select event_id, case when relevance < 0.40 or confidence < 0.52 then 'low' when confidence < 0.65 then 'medium' else 'high' end as level,
  relevance < 0.40 or confidence < 0.52 as is_fallback, case when relevance < 0.40 then 'out_of_domain' when confidence < 0.52 then 'low_confidence' end as reason,
  round(confidence, 6) as confidence from (select event_id, (event_id % 100) / 100.0::double as relevance, 1 / (1 + exp(-(value / 500.0))) as confidence from events)""")
def response_policy(t: Tables) -> DataFrame:
    relevance, confidence = (F.col("event_id") % 100) / F.lit(100.0), sigmoid(F.col("value") / 500.0)
    policy = ML.response_policy(relevance, confidence)
    return t.events.select("event_id", policy.alias("p"), F.round(confidence, 6).alias("confidence")).select("event_id", "p.*", "confidence")


# -- features


@query("""select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over (), 6) as c_acctbal, (c_mktsegment = 'BUILDING')::int as "c_mktsegment_BUILDING",
  (c_mktsegment = 'MACHINERY')::int as "c_mktsegment_MACHINERY" from customer""")
def one_hot_scale(t: Tables) -> DataFrame:
    """Drop-first indicators of three segments, and standard scores."""
    rows = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    hot = ML.one_hot(rows, "c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"])
    return ML.standard_scaled(hot, ["c_acctbal"]).drop("c_mktsegment")


def _part_features(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.length("p_name").cast("double").alias("n_name"),
                         (F.col("p_partkey") % 10).cast("double").alias("digit"), "p_retailprice")
    return dealt_in_order(rows, "p_partkey")


@query()
def ml_regressors(t: Tables) -> DataFrame:
    """Three regressors of the retail price, by r2 on held-out parts."""
    train, test = ML.hash_split(_part_features(t), F.col("p_partkey"))
    return ML.regressor_bakeoff(train, test, ["p_size", "n_name", "digit"], "p_retailprice")


def _coefficients(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    features = ["l_quantity", "l_discount", "l_tax"]
    model = ML.fit(rows, features, "l_extendedprice", ML.regressors()["linear"])
    return ML.coefficients(model, features, t.spark)


@query()
def ml_coefficients(t: Tables) -> DataFrame:
    """Coefficients and intercept of the linear model of extended price."""
    return _coefficients(t)


_PAIRS = ", ".join(f"covar_samp({a}, {b}) as {n}" for n, a, b in (
    ("a", "l_quantity", "l_quantity"), ("b", "l_quantity", "l_discount"), ("c", "l_quantity", "l_tax"), ("d", "l_discount", "l_discount"),
    ("e", "l_discount", "l_tax"), ("f", "l_tax", "l_tax"), ("u", "l_extendedprice", "l_quantity"), ("v", "l_extendedprice", "l_discount"),
    ("w", "l_extendedprice", "l_tax")))


@query(f"""with g as (select {_PAIRS}, avg(l_quantity) as m1, avg(l_discount) as m2, avg(l_tax) as m3, avg(l_extendedprice) as my from lineitem),
  x as (select *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) as det from g),
  s as (select (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det as b1, (a * (v * f - e * w) - u * (b * f - e * c) + c * (b * w - v * c)) / det as b2,
    (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det as b3, m1, m2, m3, my from x)
  select round(b1, 4) as quantity, round(b2, 3) as discount, round(b3, 3) as tax, round(my - b1 * m1 - b2 * m2 - b3 * m3, 3) as intercept from s""")
def regression_multiple(t: Tables) -> DataFrame:
    """The linear model of several features in one row; its SQL solves the normal equations by determinants."""
    fitted = _coefficients(t).groupBy().pivot("feature", ["l_quantity", "l_discount", "l_tax", "(intercept)"]).agg(F.first("coefficient"))
    return fitted.select(
        F.round("l_quantity", 4).alias("quantity"), F.round("l_discount", 3).alias("discount"), F.round("l_tax", 3).alias("tax"),
        F.round("`(intercept)`", 3).alias("intercept"),
    )


def _doc_features(t: Tables) -> DataFrame:
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    docs = t.documents.select("doc_id", F.length("text").cast("double").alias("chars"), spaces.cast("double").alias("spaces"),
                              (F.length("text") - F.length(F.regexp_replace("text", "[.!?]", ""))).cast("double").alias("stops"))
    return docs.join(t.labels.select("doc_id", "quality"), "doc_id")


@query()
def ml_classifiers(t: Tables) -> DataFrame:
    """Four classifiers of quality, with macro and weighted metrics on held-out documents."""
    train, test = ML.hash_split(_doc_features(t), F.col("doc_id"))
    return ML.classifier_bakeoff(train, test, ["chars", "spaces", "stops"], "quality")


@query()
def ml_cv(t: Tables) -> DataFrame:
    """Stratified cross validation of two candidates."""
    path = t.scratch("cv")  # the texts are read once, not for every fold and candidate
    M.stratified_fold(_doc_features(t), "quality", "doc_id", 3).write.parquet(path)
    rows = t.spark.read.parquet(path)
    every = ML.classifiers()
    return ML.cross_validate(rows, ["chars", "spaces", "stops"], "quality", {k: every[k] for k in ("logistic", "naive_bayes")})


# -- validation

_RECORDS = """r as (select event_id, case event_id % 5 when 0 then 'abc' when 1 then null else (value / 8)::decimal(12, 2)::varchar end as hours,
  case when event_id % 4 = 0 then 'Other' else 'Male' end as gender from events)"""


@query(f"""with {_RECORDS} select event_id, concat_ws('; ', case when hours is null then 'Hours_Studied: missing' when try_cast(hours as double) is null then 'Hours_Studied: not a number'
  when try_cast(hours as double) < 0 then 'Hours_Studied: below 0' when try_cast(hours as double) > 50 then 'Hours_Studied: above 50' end,
  case when gender is null or gender not in ('Male', 'Female') then 'Gender: not allowed' end) as errors from r""")
def record_validation(t: Tables) -> DataFrame:
    text = (F.col("value") / 8).cast("decimal(12,2)").cast("string")
    hours = F.when(F.col("event_id") % 5 == 0, "abc").when(F.col("event_id") % 5 == 1, None).otherwise(text)
    gender = F.when(F.col("event_id") % 4 == 0, "Other").otherwise("Male")
    rows = t.events.select("event_id", hours.alias("Hours_Studied"), gender.alias("Gender"))
    found = V.record_errors({"Hours_Studied": V.STUDENT_RANGES["Hours_Studied"]}, {"Gender": V.STUDENT_VALUES["Gender"]})
    return rows.select("event_id", F.array_join(found, "; ").alias("errors"))


@query("""select event_id, concat_ws(',', case when not (m between 1 and 12) then 'month' end,
  case when not (d between 1 and day(last_day(make_date(2023, least(greatest(m, 1), 12), 1)))) then 'day' end, case when not (h between 0 and 23) then 'hour' end) as errors
  from (select event_id, (event_id % 14)::int as m, (event_id % 33)::int as d, (event_id % 26)::int as h from events)""")
def calendar_validation(t: Tables) -> DataFrame:
    m, d, h = ((F.col("event_id") % k).cast("int") for k in (14, 33, 26))
    return t.events.select("event_id", F.array_join(V.date_parts_error(F.lit(2023), m, d, h), ",").alias("errors"))


# -- maintenance


@query("select max(s_suppkey) + 1 as next_id from supplier")
def next_id(t: Tables) -> DataFrame:
    return C.next_id(t.supplier, "s_suppkey")


@query("""select s_suppkey, s_name, s_nationkey, s_acctbal from supplier union all
  select (select max(s_suppkey) from supplier) + row_number() over (order by n), n, null, null from (values ('New A'), ('New B')) v(n)""")
def append_id(t: Tables) -> DataFrame:
    rows = t.spark.sql("select * from values ('New A'), ('New B') as v(s_name)")
    return C.append_with_id(t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), rows, "s_suppkey")


def _renamed() -> dict[str, Column]:
    return {"s_name": F.lit("Renamed"), "s_acctbal": F.col("s_acctbal") + 1, "nothing": F.lit(1)}


@query("select 's_acctbal' as column_name, s_suppkey, s_acctbal::varchar as before, (s_acctbal + 1)::varchar as after from supplier where s_suppkey = 3 union all select 's_name', s_suppkey, s_name, 'Renamed' from supplier where s_suppkey = 3")
def update_diff(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    return C.changes(s, C.update_by_id(s, "s_suppkey", 3, _renamed()), "s_suppkey")


@query("select s_suppkey, s_name from supplier where s_suppkey <> 5")
def delete_by_id(t: Tables) -> DataFrame:
    return C.delete_by_id(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", 5)


@query("select s_suppkey, s_name from (select *, row_number() over (order by s_name, s_suppkey) as n from supplier) where n <> 4")
def delete_by_position(t: Tables) -> DataFrame:
    return C.delete_by_position(t.supplier.select("s_suppkey", "s_name"), ["s_name", "s_suppkey"], 4)


@query("""with s as (select s_suppkey, s_name from supplier), r as (select 2 as s_suppkey, 'Two' as s_name union all select 100000, 'Big' union all select 7, (select upper(s_name) from supplier where s_suppkey = 9)),
  ok as (select * from r where not exists (select 1 from s where lower(trim(s.s_name)) = lower(trim(r.s_name)) and s.s_suppkey <> r.s_suppkey))
  select * from s where s_suppkey not in (select s_suppkey from ok) union all select * from ok""")
def upsert(t: Tables) -> DataFrame:
    """Rows replaced and added; one is refused since its name belongs to another."""
    s = t.supplier.select("s_suppkey", "s_name")
    new = t.spark.sql("select * from values (2L, 'Two'), (100000L, 'Big') as v(s_suppkey, s_name)")
    clash = s.filter("s_suppkey = 9").select(F.lit(7).cast("long").alias("s_suppkey"), F.upper("s_name").alias("s_name"))
    return C.upsert(s, new.unionByName(clash), "s_suppkey", unique="s_name")


@query("select event_id, event_type, value from events order by ts desc, event_id desc limit 50")
def history_newest(t: Tables) -> DataFrame:
    return newest(t.events.select("event_id", "event_type", "value", "ts"), ["ts", "event_id"]).drop("ts")


@query("""select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as record from nation""")
def json_export(t: Tables) -> DataFrame:
    return t.nation.select(as_json("n_nationkey", "n_name").alias("record"))


@query("select doc_id, 'labelled' as part, lang from documents where doc_id in (select doc_id from labels) union all select item_id, 'benchmark', null from benchmark")
def union_label(t: Tables) -> DataFrame:
    a = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit("labelled").alias("part"), "lang")
    b = t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("part"))
    return a.unionByName(b, allowMissingColumns=True)


@query("select lang from documents except select 'en' union (select 'xx' except select lang from documents)")
def set_difference(t: Tables) -> DataFrame:
    """Languages that are not expected, and expected ones that do not occur."""
    have = t.documents.select("lang").distinct()
    want = t.spark.sql("select * from values ('en'), ('xx') as v(lang)")
    return have.exceptAll(want).unionByName(want.exceptAll(have))


@query("select p_partkey, len(list_intersect(string_split(p_name, ' '), ['small', 'ring', 'red']))::int as shared, list_has_any(string_split(p_name, ' '), ['small', 'ring', 'red']) as overlaps from part")
def set_intersection(t: Tables) -> DataFrame:
    words, wanted = F.split("p_name", " "), F.array(*[F.lit(w) for w in ("small", "ring", "red")])
    return t.part.select("p_partkey", F.size(F.array_intersect(words, wanted)).alias("shared"), F.arrays_overlap(words, wanted).alias("overlaps"))


@query("select conv_id, n, first_text from (select conv_id, count(*)::bigint as n, min_by(text, turn) as first_text from conversations where role = 'assistant' and trim(text) <> '' group by 1)")
def answers_of_group(t: Tables) -> DataFrame:
    rows = t.conversations.filter("role = 'assistant' and trim(text) <> ''")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("text", "turn").alias("first_text"))


@query("select text, min(conv_id) as conv_id from conversations where role = 'assistant' group by 1")
def reverse_lookup(t: Tables) -> DataFrame:
    """Answer text to the conversation of its first occurrence."""
    return t.conversations.filter("role = 'assistant'").groupBy("text").agg(F.min("conv_id").alias("conv_id"))


@query("select conv_id, turn, row_number() over (partition by role order by length(text) desc, conv_id, turn)::int as rank, role from conversations where text is not null qualify rank <= 5")
def top_n_per_group(t: Tables) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("role").orderBy(F.desc(F.length("text")), "conv_id", "turn"))
    return t.conversations.filter("text is not null").select("conv_id", "turn", nth.alias("rank"), "role").filter("rank <= 5")
