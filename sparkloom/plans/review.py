"""Queries that review data and models: examples of what is wrong, counts, guards, text models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import validate as V
from ..functions.text import normal_tokens
from ..operators import crud as C
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import similarity as SM
from ..operators import textml as TX
from ..operators.ordering import dealt_in_order, with_position
from ..operators.tfidf import vocabulary
from .artifacts import content_documents
from .registry import Tables, query
from .retrieval import _SEEDS, _SPLIT, _TFIDF, _interactions, _popular, _triples

# -- examples of what is wrong


@query("""with d as (select l_orderkey, l_linenumber, count(*) - 1 as extra from lineitem group by 1, 2 having count(*) > 1)
  select sum(extra)::bigint as extra, (select string_agg(l_orderkey || '/' || l_linenumber, ', ' order by l_orderkey, l_linenumber) from (select * from d order by 1, 2 limit 5)) as examples from d""")
def duplicate_examples(t: Tables) -> DataFrame:
    """Rows beyond the first of their key, and the first five such keys."""
    return Q.duplicate_examples(t.lineitem, ["l_orderkey", "l_linenumber"], 5)


@query("""select doc_id from documents where doc_id not in (select doc_id from labels) order by doc_id limit 10""")
def orphan_examples(t: Tables) -> DataFrame:
    """The first ten keys without a parent."""
    return Q.orphan_keys(t.documents, t.labels, "doc_id", "doc_id", 10)


@query("""select c as column_name, n, uniques, top, freq from (
  select 'c_mktsegment' as c, count(c_mktsegment)::bigint as n, count(distinct c_mktsegment)::bigint as uniques,
    (select c_mktsegment from customer where c_mktsegment is not null group by 1 order by count(*) desc, 1 limit 1) as top,
    (select count(*) from customer where c_mktsegment is not null group by c_mktsegment order by 1 desc limit 1)::bigint as freq from customer
  union all select 'c_name', count(c_name)::bigint, count(distinct c_name)::bigint, (select c_name from customer where c_name is not null group by 1 order by count(*) desc, 1 limit 1),
    (select count(*) from customer where c_name is not null group by c_name order by 1 desc limit 1)::bigint from customer)""")
def describe_objects(t: Tables) -> DataFrame:
    """Text columns: values, distinct ones, the most frequent one (the first of equals), its count."""
    return Q.describe_objects(t.customer, ["c_mktsegment", "c_name"])


@query(r"""with r as (select lang, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*'))::bigint as n from documents where text is not null)
  select lang, count(*)::bigint as n, min(n) as min_tokens, max(n) as max_tokens from r group by 1""")
def tokens_by_group(t: Tables) -> DataFrame:
    """Per language documents, and their fewest and most tokens."""
    size = F.size(normal_tokens(F.col("text"))).cast("long")
    rows = t.documents.filter("text is not null").select("lang", size.alias("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"))


# -- pairing and maintenance


@query("""with a as (select row_number() over (order by o_orderkey) as place, o_orderkey, o_totalprice from orders),
  b as (select row_number() over (order by o_totalprice, o_orderkey) as place, o_totalprice as predicted from orders)
  select o_orderkey, round(o_totalprice - predicted, 4) as residual from a join b using (place)""")
def paired_by_position(t: Tables) -> DataFrame:
    """Two columns in orders of their own, put side by side by place."""
    actual = with_position(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], "place")
    guessed = t.orders.select(F.col("o_totalprice").alias("predicted"), F.col("o_orderkey").alias("_k"))
    said = with_position(guessed, ["predicted", "_k"], "place").drop("_k")
    return actual.join(said, "place").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("predicted"), 4).alias("residual"))


@query("""with s as (select s_suppkey, s_name from supplier), r as (select 2 as s_suppkey, ' Two  Words ' as s_name union all select 100000, 'Big'),
  a as (select * from s where s_suppkey not in (select s_suppkey from r) union all select * from r)
  select s_suppkey, s_name, lower(trim(regexp_replace(s_name, '\\s+', ' ', 'g'))) as clean_name, len(string_split(lower(trim(regexp_replace(s_name, '\\s+', ' ', 'g'))), ' '))::int as words from a""".replace("\\\\", "\\"))
def upsert_derived(t: Tables) -> DataFrame:
    """Rows replaced and added, and the columns that follow from others made anew."""
    clean = F.lower(F.trim(F.regexp_replace("s_name", r"\s+", " ")))
    derived = {"clean_name": clean, "words": F.size(F.split("clean_name", " "))}
    before = C.with_derived(t.supplier.select("s_suppkey", "s_name"), derived)
    rows = t.spark.sql("select * from values (2L, ' Two  Words '), (100000L, 'Big') as v(s_suppkey, s_name)")
    return C.upsert_derived(before, rows, "s_suppkey", derived, unique="s_name")


# -- validators

_CONTACTS = """c as (select c_custkey, case c_custkey % 4 when 0 then lower(replace(c_name, '#', '.')) || '@mail.org' when 1 then 'no at sign' when 2 then ' A.b+c@x-y.co ' else null end as email,
  case c_custkey % 3 when 0 then '+49 (30) 123-' || c_custkey % 1000 when 1 then '12' else null end as phone, (c_custkey % 13)::varchar as power from customer)"""


@query(rf"""with {_CONTACTS} select c_custkey, coalesce(regexp_matches(trim(email), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}$'), false) as email_ok,
  coalesce(regexp_matches(trim(phone), '^\+?[0-9][0-9 ()-]{{6,18}}$'), false) as phone_ok,
  case when try_cast(power as double) > 10 then 'Global_active_power: above 10' end as power_error from c""")
def contact_validation(t: Tables) -> DataFrame:
    """E-mail, phone and power of each row."""
    key = F.col("c_custkey")
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.org"))
    email = F.when(key % 4 == 0, mail).when(key % 4 == 1, "no at sign").when(key % 4 == 2, " A.b+c@x-y.co ")
    phone = F.when(key % 3 == 0, F.concat(F.lit("+49 (30) 123-"), (key % 1000).cast("string"))).when(key % 3 == 1, "12")
    low, high = V.POWER_RANGES["Global_active_power"]
    power = V.number_error((key % 13).cast("string"), "Global_active_power", low, high)
    return t.customer.select(
        "c_custkey", V.is_email(email).alias("email_ok"), V.is_phone(phone).alias("phone_ok"), power.alias("power_error")
    )


_STUDENT_NUMBERS = {"Hours_Studied": 60, "Attendance": 120, "Sleep_Hours": 30, "Previous_Scores": 110, "Tutoring_Sessions": 12, "Physical_Activity": 13}
_STUDENT_CHOICES = ("Gender", "School_Type", "Motivation_Level")


def _student_sql() -> str:
    numbers = [
        f"case when event_id % {m} > {int(V.STUDENT_RANGES[c][1])} then '{c}: above {V.STUDENT_RANGES[c][1]:g}' end" for c, m in _STUDENT_NUMBERS.items()
    ]
    choices = [f"case when event_id % {i + 3} = 0 then '{c}: not allowed' end" for i, c in enumerate(_STUDENT_CHOICES)]
    return f"select event_id, concat_ws('; ', {', '.join([*numbers, *choices])}) as errors from events"


@query(_student_sql())
def student_validation(t: Tables) -> DataFrame:
    """Six numbers and three choices of a record, with all that is wrong."""
    number = {c: (F.col("event_id") % m).cast("string").alias(c) for c, m in _STUDENT_NUMBERS.items()}
    choice = {c: F.when(F.col("event_id") % (i + 3) == 0, "?").otherwise(V.STUDENT_VALUES[c][0]).alias(c) for i, c in enumerate(_STUDENT_CHOICES)}
    rows = t.events.select("event_id", *number.values(), *choice.values())
    found = V.record_errors({c: V.STUDENT_RANGES[c] for c in _STUDENT_NUMBERS}, {c: V.STUDENT_VALUES[c] for c in _STUDENT_CHOICES})
    return rows.select("event_id", F.array_join(found, "; ").alias("errors"))


# -- guards of features, recommendations and evaluations


@query(f"""with {_TFIDF}, i as (select id, row_number() over (order by id) - 1 as row_index from (select distinct id from d)),
  v as (select id, string_agg(term || ':' || round(weight, 9), ' ' order by term) as vec from triples group by 1),
  c as (select p_partkey as id, lower(p_name) || case when p_partkey % 5 = 0 then '' else ' ' || p_type || ' ' || p_brand end as text, p_partkey % 5 = 0 as bare from part)
  select 'row_for_every_item' as check_name, (select count(*) from c) = (select count(*) from part) as passed
  union all select 'index_rows', (select count(*) from i) = (select count(*) from part)
  union all select 'index_contiguous', (select min(row_index) = 0 and max(row_index) = count(*) - 1 and count(distinct row_index) = count(*) from i)
  union all select 'vocabulary_not_empty', (select count(*) from kept) > 0
  union all select 'vectors_differ', (select count(distinct vec) > 1 from v)
  union all select 'content_without_tags', (select count_if(text is null or trim(text) = '') from c where bare) = 0""")
def feature_guards(t: Tables) -> DataFrame:
    """What has to hold of items, their index, the vocabulary and the vectors."""
    spark, folder = t.spark, t.sf_dir
    content = content_documents(spark, folder)
    rows = content.join(t.part.select("p_partkey", F.lit(True).alias("known")), "p_partkey", "full_outer")
    bare = F.col("num_tags") == 0
    first = Q.checks(rows, {
        "row_for_every_item": F.count_if(F.col("content").isNull() | F.col("known").isNull()) == 0,
        "content_without_tags": F.count_if(bare & (F.coalesce(F.trim("content"), F.lit("")) == "")) == 0,
    })
    index = with_position(t.part.select("p_partkey").distinct(), ["p_partkey"], "place").withColumn("row_index", F.col("place") - 1)
    second = Q.checks(index.join(t.part.select("p_partkey", F.lit(True).alias("known")), "p_partkey", "full_outer"), {
        "index_rows": F.count_if(F.col("row_index").isNull() | F.col("known").isNull()) == 0,
        "index_contiguous": (F.min("row_index") == 0) & (F.max("row_index") == F.count("*") - 1) & (F.sum("row_index") * 2 == F.count("*") * (F.count("*") - 1)),
    })
    tokens = normal_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    known = vocabulary(t.part.select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey", tokens)
    third = Q.checks(known, {"vocabulary_not_empty": F.count("*") > 0})
    each = _triples(t).groupBy("p_partkey").agg(F.sum(F.xxhash64("term", F.round("weight", 9)).cast("decimal(38,0)")).alias("vector"))
    fourth = Q.checks(each, {"vectors_differ": F.max("vector") > F.min("vector")})
    return first.unionByName(second).unionByName(third).unionByName(fourth)


@query(f"""with {_TFIDF}, {_SEEDS}, pairs as (select seed, i.p_partkey as id from seeds, part i where i.p_partkey <> seed),
  met as (select q.id as seed, t.id, sum(q.weight * t.weight) as s from triples q join triples t using (term) where q.id in (select seed from seeds) group by 1, 2),
  sc as (select p.seed, p.id, round(coalesce(s, 0), 6) as score from pairs p left join met using (seed, id)),
  rk as (select *, row_number() over (partition by seed order by score desc, id) as rank, count(*) over (partition by seed, id) as times from sc qualify rank <= 10)
  select 'dimensions' as check_name, (select count(distinct id) > 0 and count(distinct term) > 0 from triples) as passed
  union all select 'candidates_not_empty', (select count(*) > 0 from part where p_name is not null and trim(p_name) <> '')
  union all select 'at_most_k', (select max(n) <= 10 and min(n) > 0 from (select count(*) as n from rk group by seed))
  union all select 'no_self', (select count_if(seed = id) = 0 from rk)
  union all select 'items_once', (select max(times) = 1 from rk)
  union all select 'names_valid', (select count_if(p_name is null or trim(p_name) = '') = 0 from rk left join part on p_partkey = id)
  union all select 'unknown_item_gives_none', (select count(*) = 0 from triples where id = -1)""")
def recommendation_guards(t: Tables) -> DataFrame:
    """What has to hold of the model and of the recommendations of the most rated items."""
    triples = _triples(t)
    items = t.part.select("p_partkey", "p_name")
    recs = SM.similar_items(triples, "p_partkey", _popular(t, 3), 10)
    rows = recs.join(items, "p_partkey", "left").withColumns({
        "n": F.count("*").over(Window.partitionBy("seed")), "times": F.count("*").over(Window.partitionBy("seed", "p_partkey")),
    })
    parts = [
        Q.checks(triples, {"dimensions": (F.count_distinct("p_partkey") > 0) & (F.count_distinct("term") > 0)}),
        Q.checks(items, {"candidates_not_empty": F.count_if(F.trim("p_name") != "") > 0}),
        Q.checks(rows, {
            "at_most_k": (F.max("n") <= 10) & (F.min("n") > 0), "no_self": F.count_if(F.col("seed") == F.col("p_partkey")) == 0,
            "items_once": F.max("times") == 1, "names_valid": F.count_if(F.coalesce(F.trim("p_name"), F.lit("")) == "") == 0,
        }),
        Q.checks(SM.similar_items(triples, "p_partkey", [-1], 10), {"unknown_item_gives_none": F.count("*") == 0}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""with {_SPLIT}, u as (select o_custkey, count_if(not is_test and q >= 25) as liked, count_if(is_test and q >= 25) as relevant from sp group by 1)
  select count(*)::bigint as users, count_if(liked = 0)::bigint as without_history, count_if(liked > 0 and relevant = 0)::bigint as without_relevant,
  count_if(liked > 0 and relevant > 0)::bigint as evaluated from u""")
def evaluation_counts(t: Tables) -> DataFrame:
    """How many users an evaluation judges, and why it skips the others."""
    split = R.temporal_split(_interactions(t), "o_custkey", "ts", "l_partkey")
    liked = F.col("q") >= 25
    return R.skip_counts(split.filter(~F.col("is_test") & liked), split.filter(F.col("is_test") & liked), split, "o_custkey")


# -- text models


def _texts(t: Tables) -> DataFrame:
    return t.documents.filter("text is not null and lang is not null").select("doc_id", "text", "lang")


@query()
def ml_text_selection(t: Tables) -> DataFrame:
    """The whole grid of text classifiers of the language by stratified cross validation, the best first."""
    folds = M.stratified_fold(_texts(t), "lang", "doc_id", 3)
    return TX.select_text_model(folds, "text", "lang", t.scratch("folds"))


@query()
def ml_text_refit(t: Tables) -> DataFrame:
    """The best of the grid on the training rows, fitted again on all of them, on held-out ones."""
    train, test = ML.hash_split(_texts(t), F.col("doc_id"))
    selected = TX.select_text_model(M.stratified_fold(train, "lang", "doc_id", 2), "text", "lang", t.scratch("refit"))
    best = selected.first()["model"]  # one row
    model, names = TX.fit_text(train, "text", "lang", *TX.grid()[best], t.scratch("refit"))
    return M.multiclass_metrics(TX.said(model, names, test), "lang", "said").withColumn("model", F.lit(best))


@query()
def ml_text_classifiers(t: Tables) -> DataFrame:
    """Four kinds of classifier of the language on the same TF-IDF, by f1 on held-out documents."""
    # a forest holds a number for every term and row, 80 kB a row for 20,000 terms
    train, test = ML.hash_split(dealt_in_order(_texts(t), "doc_id", rows=8_000), F.col("doc_id"))
    return TX.compare_classifiers(train, test, "text", "lang")


@query()
def ml_text_margins(t: Tables) -> DataFrame:
    """What a support vector machine for each language says of held-out documents, with margin and confidence."""
    train, test = ML.hash_split(_texts(t), F.col("doc_id"))
    model, names = TX.fit_text(train, "text", "lang", 1, TX.classifiers()["linear_svm"])
    return TX.margins(model, names, test).drop("text")


@query()
def ml_top_terms(t: Tables) -> DataFrame:
    """The ten heaviest terms of each language in the machine for it."""
    model, names = TX.fit_text(_texts(t), "text", "lang", 1, TX.classifiers()["linear_svm"], t.scratch("top"))
    return TX.top_terms(model, names, t.documents, 10)


@query()
def ml_calibrated(t: Tables) -> DataFrame:
    """Cross-fitted probabilities of quality from a machine on TF-IDF, in tenths: n, mean probability, share of label 1."""
    docs = t.documents.filter("text is not null").select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id")
    path = t.scratch("calibrated")
    M.stratified_fold(docs, "quality", "doc_id", 3).write.parquet(f"{path}-rows")
    rows = t.spark.read.parquet(f"{path}-rows")
    TX.TfIdf(inputCol="text", sizes=[1]).fit(rows).transform(rows).select("doc_id", "quality", "fold", "features").write.parquet(path)
    rows = t.spark.read.parquet(path)
    return TX.reliability(TX.calibrate(rows, "quality").probabilities(rows), "quality")


@query(f"with {_TFIDF} select id as p_partkey, term, round(weight, 6) as weight from triples")
def tfidf_stage(t: Tables) -> DataFrame:
    """The weights of the pipeline stage, learned, saved and read back."""
    rows = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    path = t.scratch("stage")
    TX.TfIdf(inputCol="text").fit(rows).save(path)
    return TX.triples(TX.TfIdfModel.load(path), rows, "p_partkey").withColumn("weight", F.round("weight", 6))
