"""Queries on batch inference, curves, summaries, and what joins text to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formatting as FM
from ..functions.text import STOPWORDS, normal_tokens, remove_stopwords
from ..operators import inference as I
from ..operators import models as ML
from ..operators.quality import melt
from ..operators.tfidf import compared
from ..operators.ordering import column_quantiles, dealt_in_order
from .registry import Tables, query

_RAW = "r as (select event_id, case when event_id % 6 = 0 then 'x' when event_id % 6 = 1 then null else value::varchar end as a, user_id::varchar as b from events)"


def _raw(t: Tables) -> DataFrame:
    a = F.when(F.col("event_id") % 6 == 0, "x").when(F.col("event_id") % 6 == 1, None).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", a.alias("a"), F.col("user_id").cast("string").alias("b"))


@query(f"with {_RAW} select event_id, try_cast(a as double) as a, try_cast(b as double) as b, try_cast(a as double) is not null and try_cast(b as double) is not null as valid from r")
def feature_projection(t: Tables) -> DataFrame:
    return I.feature_rows(_raw(t), "event_id", ["a", "b"])


@query(f"with {_RAW} select event_id, round(case when try_cast(a as double) is not null then greatest(0, least(100, 10.0 + try_cast(a as double) * 0.5 - try_cast(b as double) * 0.25)) end, 6) as prediction, case when try_cast(a as double) is null then 'invalid input' end as error from r")
def batch_inference(t: Tables) -> DataFrame:
    """Predictions within bounds; rows that cannot be scored say so instead of failing."""
    scored = I.linear_scores(I.feature_rows(_raw(t), "event_id", ["a", "b"]), {"a": 0.5, "b": -0.25}, 10.0, 0, 100)
    return scored.select("event_id", F.round("prediction", 6).alias("prediction"), F.when(~F.col("valid"), "invalid input").alias("error"))


@query("select vec_id, round(1 / (1 + exp(-(s[1] - s[2]))), 6) as confidence from (select vec_id, list_reverse_sort(embedding::double[]) as s from embeddings)")
def margin_confidence(t: Tables) -> DataFrame:
    """The components of a vector taken as scores of classes."""
    scores = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(I.margin_confidence(scores), 6).alias("confidence"))


_SCORES = "b as (select quality, least(n_chars // 500, 20)::bigint as s from documents join labels using (doc_id))"


@query(f"""with {_SCORES}, c as (select s, count_if(quality = 1) as p, count_if(quality = 0) as q from b group by 1)
  select s as threshold, round(sum(q) over (order by s desc) / sum(q) over (), 6) as fpr, round(sum(p) over (order by s desc) / sum(p) over (), 6) as tpr,
  round(sum(p) over (order by s desc) / sum(p + q) over (order by s desc), 6) as precision from c""")
def roc_points(t: Tables) -> DataFrame:
    score = F.least(F.floor(F.col("n_chars") / 500), F.lit(20))
    joined = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select("quality", score.alias("s"))
    return I.roc_points(joined, F.col("quality"), F.col("s"))


@query("""select feature, weight, case when weight >= 0 then '+' else '-' end as sign, row_number() over (order by abs(weight) desc, feature)::int as rank from (
  select n_name as feature, round(avg(s_acctbal), 6) - 4500 as weight from supplier join nation on s_nationkey = n_nationkey group by 1) order by abs(weight) desc, feature limit 5""")
def top_weights(t: Tables) -> DataFrame:
    joined = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    means = joined.groupBy(F.col("n_name").alias("feature")).agg((F.round(F.avg("s_acctbal"), 6) - 4500).alias("weight"))
    return I.top_weights(means, "feature", "weight", 5)


@query()
def ml_importances(t: Tables) -> DataFrame:
    """What a forest of the retail price looks at."""
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 10).cast("double").alias("digit"), "p_retailprice")
    model = ML.fit(dealt_in_order(rows, "p_partkey"), ["p_size", "digit"], "p_retailprice", ML.regressors()["random_forest"])
    return ML.importances(model, ["p_size", "digit"], t.spark)


@query()
def ml_reload(t: Tables) -> DataFrame:
    """A saved and reloaded model gives the same predictions: rows, largest difference."""
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    model = ML.fit(rows, ["p_size"], "p_retailprice", ML.regressors()["linear"])
    again = ML.reloaded(model, t.scratch("model"))
    return ML.same_predictions(model.transform(rows), again.transform(rows), "p_partkey")


_NUMBERS = ("o_totalprice", "o_custkey")


@query(" union all ".join(
    f"""select '{c}' as column_name, count({c})::bigint as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c})::double as min,
  quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.5) as median, quantile_cont({c}::double, 0.75) as q3, max({c})::double as max from orders"""
    for c in _NUMBERS
))
def describe_numeric(t: Tables) -> DataFrame:
    """Moments in one pass; the quantiles of all columns by one selection."""
    aggs, parts = [], []
    for c in _NUMBERS:
        d = F.col(c).cast("double")
        values = {"n": F.count(d), "mean": F.round(F.avg(d), 4), "std": F.round(F.stddev_samp(d), 4), "min": F.min(d), "max": F.max(d)}
        aggs += [v.alias(f"{c}_{n}") for n, v in values.items()]
        q = [F.col(f"{c}_q{i}") for i in (1, 2, 3)]
        parts.append((c, [F.col(f"{c}_n"), F.col(f"{c}_mean"), F.col(f"{c}_std"), F.col(f"{c}_min"), *q, F.col(f"{c}_max")]))
    one = column_quantiles(t.orders, {c: F.col(c) for c in _NUMBERS}, {f"q{i}": i / 4 for i in (1, 2, 3)})  # one row
    return melt(t.orders.agg(*aggs).crossJoin(F.broadcast(one)), parts, ["column_name", "n", "mean", "std", "min", "q1", "median", "q3", "max"])


@query("""select 'n_rows' as item, '' as value, count(*)::double as amount from customer union all select 'mean_balance', '', round(avg(c_acctbal), 4) from customer
  union all select 'segment', coalesce(c_mktsegment, 'Unknown'), count(*)::double from customer group by 2""")
def dataset_summary(t: Tables) -> DataFrame:
    """Numbers and categories of a table in one long result."""
    c = t.customer
    one = c.agg(F.count("*").cast("double").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("m"))
    numbers = melt(one, [("n_rows", [F.lit(""), F.col("n")]), ("mean_balance", [F.lit(""), F.col("m")])], ["item", "value", "amount"])
    groups = c.groupBy(F.coalesce("c_mktsegment", F.lit("Unknown")).alias("value")).agg(F.count("*").cast("double").alias("amount"))
    return numbers.unionByName(groups.withColumn("item", F.lit("segment")))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*')"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


@query(f"""with w as (select toxic, unnest({_WORDS}) as word from documents join labels using (doc_id)), c as (select toxic, word, count(*)::bigint as n from w where not list_contains({_STOP}, word) group by 1, 2)
  select toxic, word, n from c qualify row_number() over (partition by toxic order by n desc, word) <= 200""")
def wordcloud_top(t: Tables) -> DataFrame:
    """The 200 most frequent words of each label without stop words."""
    docs = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "toxic"), "doc_id")
    words = docs.select("toxic", F.explode(remove_stopwords(normal_tokens(F.col("text")))).alias("word"))
    n = words.groupBy("toxic", "word").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy(F.desc("n"), "word"))
    return n.withColumn("_r", nth).filter("_r <= 200").drop("_r")


def _config(stop: bool, low: int, high: float, sub: bool) -> str:
    words = f"list_filter({_WORDS.replace('text', 'p_name || chr(32) || p_type || chr(32) || p_brand')}, lambda w: not list_contains({_STOP}, w))" if stop else _WORDS.replace("text", "p_name || chr(32) || p_type || chr(32) || p_brand")
    return f"""d as (select p_partkey as id, {words} as w from part), g as (select id, unnest(w) as term from d), tf as (select id, term, count(*) as tf from g group by 1, 2),
      st as (select term, count(*) as df from tf group by 1), kept as (select term, ln((1.0::double + n) / (1.0::double + df)) + 1.0 as idf from st, (select count(distinct id) as n from d) where df >= {low} and df <= n * {high}),
      raw as (select id, term, ({'(1.0 + ln(tf::double))' if sub else 'tf::double'}) * idf as w from tf join kept using (term)), tr as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from raw)"""


_CONFIGS = (("plain", False, 1, 1.0, False), ("sublinear", False, 1, 1.0, True), ("common", True, 5, 0.95, True), ("rare_off", True, 50, 0.5, False))


@query(" union all ".join(f"(with {_config(*c[1:])} select '{c[0]}' as config, count(*)::bigint as entries, count(distinct term)::bigint as terms, round(sum(weight), 3) as total from tr)" for c in _CONFIGS))
def tfidf_configs(t: Tables) -> DataFrame:
    """Four settings of TF-IDF side by side."""
    docs = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    settings = [(name, STOPWORDS if stop else (), low, high, sub) for name, stop, low, high, sub in _CONFIGS]
    return compared(docs, "p_partkey", normal_tokens(F.col("t")), settings, t.scratch("configs"))


@query("select doc_id from documents order by md5('42:' || doc_id), doc_id limit 100")
def seeded_sample(t: Tables) -> DataFrame:
    """A sample of a hundred ids that stays the same: the order of a seeded hash."""
    return t.documents.select("doc_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(100)


@query("""select o_orderkey, printf('%.2f%%', (o_totalprice / 499979) * 100) as share, case when length(o_orderpriority) > 8 then substr(o_orderpriority, 1, 5) || '...' else o_orderpriority end as short,
  printf('%dh %02dm %02ds', (o_totalprice::bigint // 3600), (o_totalprice::bigint // 60) % 60, o_totalprice::bigint % 60) as took from (select o_orderkey, floor(o_totalprice) as o_totalprice, o_orderpriority from orders)""")
def formatted(t: Tables) -> DataFrame:
    price = F.floor("o_totalprice")
    return t.orders.select("o_orderkey", FM.percent(price / 499_979).alias("share"), FM.truncated(F.col("o_orderpriority"), 8).alias("short"), FM.duration(price).alias("took"))


@query("""with q as (select conv_id, turn, text, min(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between 1 following and unbounded following) as answer_turn, role from conversations)
  select q.conv_id, q.turn, trim(q.text) as question, trim(a.text) as answer from q join conversations a on a.conv_id = q.conv_id and a.turn = q.answer_turn
  where q.role = 'user' and q.text is not null and trim(q.text) <> '' and trim(a.text) <> ''""")
def question_answer_pairs(t: Tables) -> DataFrame:
    """Each question with the next answer of its conversation; blank ones are dropped."""
    after = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    answer = F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).over(after)
    rows = t.conversations.select("conv_id", "turn", "role", "text", answer.alias("a"))
    rows = rows.select("conv_id", "turn", "role", F.trim("text").alias("question"), F.trim("a.text").alias("answer"))
    return rows.filter("role = 'user' and question <> '' and answer <> ''").drop("role")


@query("""with known as (select distinct text from benchmark), d as (select doc_id, source, text from documents)
  select doc_id, case when source = 'src1' and doc_id % 2 = 0 then 'filled' when d.text in (select text from known) then 'member' else source end as source from d""")
def membership_fill(t: Tables) -> DataFrame:
    """A column filled by a rule, else by whether the text is in another table."""
    known = t.benchmark.select(F.col("text").alias("_k")).distinct().withColumn("_hit", F.lit(True))
    rows = t.documents.select("doc_id", "source", "text")
    met = rows.join(known, rows["text"] == known["_k"], "left")
    rule = (F.col("source") == "src1") & (F.col("doc_id") % 2 == 0)
    filled = F.when(rule, "filled").when(F.col("_hit"), "member").otherwise(F.col("source"))
    return met.select("doc_id", filled.alias("source"))
