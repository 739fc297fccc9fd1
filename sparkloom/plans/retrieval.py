"""Queries on search, candidates, TF-IDF, similarity, splits and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_tokens, split_values
from ..operators import ranking as R
from ..operators import search as OS
from ..operators import similarity as SM
from ..operators import stats as S
from ..operators.blocks import dense_top_k, sparse_top_k
from ..operators.tfidf import norms, tfidf
from .registry import Tables, query


@query("select c_custkey, c_name, c_mktsegment from customer where lower(c_mktsegment) = 'building'")
def search_exact(t: Tables) -> DataFrame:
    return OS.matching(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_mktsegment", " Building ", exact=True)


@query("select p_partkey, p_name, p_type from part where contains(lower(p_name), 'ring') and contains(lower(p_type), 'e')")
def search_multi(t: Tables) -> DataFrame:
    return OS.matching_all(t.part.select("p_partkey", "p_name", "p_type"), {"p_name": " RING ", "p_type": "e", "nothing": "x"})


@query("select p_partkey, p_name from part where regexp_matches(lower(p_name), '^s.*(ring|bolt)$') order by p_partkey limit 25 offset 10")
def list_page(t: Tables) -> DataFrame:
    return OS.page(t.part.select("p_partkey", "p_name"), ["p_partkey"], "^S.*(ring|bolt)$", "p_name", 10, 25)


_COUNTS = "select l_partkey, count(*)::bigint as rating_count from lineitem group by 1"


def _counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("rating_count"))


@query(f"with c as ({_COUNTS}) select p_partkey, p_name, coalesce(rating_count, 0)::bigint as rating_count from part left join c on l_partkey = p_partkey where contains(lower(p_name), 'small r') order by 3 desc, 1 limit 1")
def title_search(t: Tables) -> DataFrame:
    return OS.title_search(t.part.select("p_partkey", "p_name"), _counts(t), "p_partkey", "p_name", "Small R")


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey = 7")
def point_lookup(t: Tables) -> DataFrame:
    return t.customer.filter("c_custkey = 7").select("c_custkey", "c_name", "c_acctbal").limit(1)


@query(f"""with c as ({_COUNTS}) select p_partkey, p_name, p_size, coalesce(rating_count, 0)::bigint as rating_count from part left join c on l_partkey = p_partkey
  where p_name is not null and trim(p_name) <> '' and coalesce(rating_count, 0) >= 28 and list_has_any(string_split(lower(p_name), ' '), ['ring', 'bolt']) and p_size >= 5 and p_size <= 40""")
def candidate_filter(t: Tables) -> DataFrame:
    genres = split_values(F.regexp_replace("p_name", " ", "|"))
    rows = t.part.select("p_partkey", "p_name", "p_size")
    return OS.candidates(rows, _counts(t), "p_partkey", "p_name", genres, 28, (" Ring", "BOLT "), (5, 40), "p_size")


@query("select coalesce(r_regionkey::varchar, 'N/A') as r_regionkey, coalesce(r_name, 'N/A') as r_name from region")
def display_projection(t: Tables) -> DataFrame:
    return OS.display(t.region, ["r_regionkey", "r_name", "r_population"])


_TFIDF = r"""d as (select p_partkey as id, regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*') as w from part),
  g as (select id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from d),
  tf as (select id, term, count(*) as tf from g group by 1, 2), st as (select term, count(*) as df, sum(tf) as total from tf group by 1),
  kept as (select term, ln((1.0::double + n) / (1.0::double + df)) + 1.0 as idf from st, (select count(distinct id) as n from d)
    where df >= 2 and df <= n * 0.9 order by total desc, term limit 20000),
  raw as (select id, term, (1.0 + ln(tf::double)) * idf as w from tf join kept using (term)),
  triples as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from raw)"""


def _triples(t: Tables) -> DataFrame:
    tokens = normal_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return tfidf(t.part.select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey", tokens)


@query(f"with {_TFIDF} select id as p_partkey, term, round(weight, 6) as weight from triples")
def tfidf_weights(t: Tables) -> DataFrame:
    return _triples(t).withColumn("weight", F.round("weight", 6))


@query(f"with {_TFIDF} select id as p_partkey, round(sqrt(sum(weight * weight)), 6) as norm, abs(sqrt(sum(weight * weight)) - 1) <= 1e-3 as is_unit from triples group by 1")
def tfidf_norms(t: Tables) -> DataFrame:
    return norms(_triples(t), "p_partkey").withColumn("norm", F.round("norm", 6))


_SEEDS = "seeds as (select l_partkey as seed from lineitem group by 1 order by count(*) desc, 1 limit 3)"


def _popular(t: Tables, k: int) -> DataFrame:
    """The k most rated items, as a table of k rows."""
    return _counts(t).orderBy(F.desc("rating_count"), "p_partkey").limit(k).select("p_partkey")


@query(f"""with {_TFIDF}, {_SEEDS}, pairs as (select seed, i.p_partkey as id from seeds, part i where i.p_partkey <> seed),
  met as (select q.id as seed, t.id, sum(q.weight * t.weight) as s from triples q join triples t using (term) where q.id in (select seed from seeds) group by 1, 2),
  sc as (select p.seed, p.id, round(coalesce(s, 0), 6) as score from pairs p left join met using (seed, id)),
  rk as (select *, row_number() over (partition by seed order by score desc, id)::int as rank from sc)
  select seed, id as p_partkey, score, rank from rk where rank <= 10""")
def similar_items(t: Tables) -> DataFrame:
    """The ten most similar parts of the three most rated ones."""
    return SM.similar_items(_triples(t), "p_partkey", _popular(t, 3), 10)


@query(f"""with {_TFIDF}, {_SEEDS}, c as ({_COUNTS}),
  allowed as (select p_partkey as id from part left join c on l_partkey = p_partkey where coalesce(rating_count, 0) >= 25 and p_name is not null and trim(p_name) <> ''
    and list_has_any(string_split(lower(p_name), ' '), ['ring', 'bolt'])),
  met as (select q.id as seed, t.id, sum(q.weight * t.weight) as s from triples q join triples t using (term) where q.id in (select seed from seeds limit 1) group by 1, 2),
  sc as (select seed, a.id, round(coalesce(s, 0), 6) as score from (select seed, id from (select seed from seeds limit 1), allowed where id <> seed) a left join met using (seed, id)),
  rk as (select *, row_number() over (order by score desc, id)::int as rank from sc)
  select rank, seed, id as p_partkey, p_name, score from rk join part on p_partkey = id where rank <= 10""")
def recommend_similar(t: Tables) -> DataFrame:
    """Candidates by genre and ratings, ranked by similarity to the most rated part, named."""
    genres = split_values(F.regexp_replace("p_name", " ", "|"))
    items = t.part.select("p_partkey", "p_name")
    allowed = OS.candidates(items, _counts(t), "p_partkey", "p_name", genres, 25, ("ring", "bolt")).select("p_partkey")
    found = SM.similar_items(_triples(t), "p_partkey", _popular(t, 1), 10, allowed)
    return found.join(items, "p_partkey").select("rank", "seed", "p_partkey", "p_name", "score")


@query(f"""with {_TFIDF}, u as (select o_custkey from orders group by 1 order by count(*) desc, 1 limit 1),
  liked as (select distinct o_custkey, l_partkey as id from orders join lineitem on l_orderkey = o_orderkey where l_quantity >= 30 and o_custkey in (select * from u)),
  p as (select term, sum(weight) / (select count(*) from liked) as w from liked join triples using (id) group by 1),
  pn as (select term, w / sqrt(sum(w * w) over ()) as w from p),
  sc as (select id, round(sum(w * weight), 6) as score from pn join triples using (term) where id not in (select id from liked) group by 1)
  select (select * from u) as o_custkey, id as p_partkey, score, row_number() over (order by score desc, id)::int as rank from sc qualify rank <= 10""")
def similar_profile(t: Tables) -> DataFrame:
    """What is most similar to the mean of what the most active customer liked."""
    active = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(1)
    mine = t.orders.select("o_orderkey", "o_custkey").join(F.broadcast(active.select("o_custkey")), "o_custkey", "left_semi")
    big = t.lineitem.filter("l_quantity >= 30").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    liked = mine.join(big, mine["o_orderkey"] == big["l_orderkey"]).select("o_custkey", "p_partkey").distinct()
    triples = _triples(t)
    met = SM.scores(SM.profiles(triples, liked, "o_custkey", "p_partkey"), triples, "o_custkey", "p_partkey", small=True)  # of one customer
    return SM.top_k(met.join(liked, ["o_custkey", "p_partkey"], "left_anti"), "o_custkey", "p_partkey", 10)


_CONV = r"""d as (select conv_id, turn, role, conv_id * 1000 + turn as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*') as w from conversations where text is not null),
  g as (select id, unnest(w) as term from d),
  tf as (select id, term, count(*) as tf from g group by 1, 2), st as (select term, count(*) as df, sum(tf) as total from tf group by 1),
  kept as (select term, ln((1.0::double + n) / (1.0::double + df)) + 1.0 as idf from st, (select count(distinct id) as n from d) where df >= 2 and df <= n * 0.9),
  raw as (select id, term, (1.0 + ln(tf::double)) * idf as w from tf join kept using (term)),
  triples as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from raw),
  q as (select id as q, conv_id, term, weight from triples join d using (id) where role = 'user' and conv_id % 100 = 0),
  a as (select id as a, conv_id, term, weight from triples join d using (id) where role = 'assistant'),
  sc as (select q, a, any_value(q.conv_id) as qc, any_value(a.conv_id) as ac, round(sum(q.weight * a.weight), 6) as score from q join a using (term) group by 1, 2)"""


def _questions(t: Tables) -> DataFrame:
    """The stated query set, with or without text: q and its group of conversations."""
    asked = t.conversations.filter("role = 'user' and conv_id % 100 = 0 and turn is not null")
    q = (F.col("conv_id") * 1000 + F.col("turn")).alias("q")
    return asked.select(q).distinct().withColumn("g", F.expr("floor(q / 1000) % 5"))


def _best_answers(t: Tables, grouped: bool) -> DataFrame:
    """The best answer of every question of the stated set by exact cosine, of its own group if grouped."""
    c = t.conversations.filter("text is not null").select("conv_id", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    triples = tfidf(c, "id", normal_tokens(F.col("text")), sizes=(1,), max_features=None)
    group = F.expr("conv_id % 5") if grouped else F.lit(0)
    named = triples.join(c.select("id", group.alias("g"), F.expr("role = 'user' and conv_id % 100 = 0").alias("asks"), F.expr("role = 'assistant'").alias("says")), "id")
    folder = t.scratch("answers")
    named.filter("asks or says").write.parquet(folder)
    named = t.spark.read.parquet(folder)
    says = named.filter("says").select(F.col("id").alias("a"), "g", "term", "weight")
    asked = named.filter("asks").select(F.col("id").alias("q"), "g", "term", "weight")
    return sparse_top_k(asked, says, "q", "a", 1, part="g" if grouped else None).select("q", "a", "score")


_ASKED = "asked as (select distinct conv_id * 1000 + turn as q, conv_id % 5 as grp from conversations where role = 'user' and conv_id % 100 = 0 and turn is not null)"


@query(f"""with {_CONV}, {_ASKED}, best as (select q, max(score) as best from sc group by 1)
  select asked.q as question_id, coalesce(best, 0.0) as relevance, coalesce(best, 0.0) < 0.40 as out_of_domain from asked left join best using (q)""")
def query_relevance(t: Tables) -> DataFrame:
    """Questions that share no term with any answer have relevance 0."""
    best = _best_answers(t, False)
    relevance = F.coalesce("score", F.lit(0.0))
    return _questions(t).join(best, "q", "left").select(F.col("q").alias("question_id"), relevance.alias("relevance"), (relevance < 0.40).alias("out_of_domain"))


@query(f"""with {_CONV}, {_ASKED}, best as (select q, a, score from (select q, a, score, row_number() over (partition by q order by score desc, a) as r from sc where qc % 5 = ac % 5) where r = 1),
  firsts as (select conv_id % 5 as grp, min(conv_id * 1000 + turn) as first from conversations where role = 'assistant' and text is not null group by 1)
  select asked.q as question_id, coalesce(a, first) as answer_id, coalesce(score, 0.0) as score from asked left join firsts using (grp) left join best using (q)""")
def best_answer(t: Tables) -> DataFrame:
    """The best answer of the question's own group of conversations.

    Where no term is shared it is the group's first answer, with score 0; null in a group without answers.
    """
    answers = t.conversations.filter("role = 'assistant' and text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("a"))
    first = answers.groupBy(F.expr("floor(a / 1000) % 5").alias("g")).agg(F.min("a").alias("first"))
    every = _questions(t).join(F.broadcast(first), "g", "left").join(_best_answers(t, True), "q", "left")
    return every.select(F.col("q").alias("question_id"), F.coalesce("a", "first").alias("answer_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


@query("""with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 100 = 0),
  sc as (select query_id, vec_id, round(list_dot_product(e, embedding::double[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 5) as score
    from q, embeddings where vec_id <> query_id)
  select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from sc qualify rank <= 10""")
def dense_cosine_topk(t: Tables) -> DataFrame:
    """Every hundredth vector against all: a stated query set in broadcast blocks."""
    e = t.embeddings.select("vec_id", "embedding")
    return dense_top_k(e, "vec_id", "embedding", e.filter("vec_id % 100 = 0"), 10)


_INTER = "i as (select o_custkey, l_partkey, max(o_orderdate) as ts, max(l_quantity) as q from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)"
_SPLIT = f"""{_INTER}, s as (select *, count(*) over (partition by o_custkey) as n, row_number() over (partition by o_custkey order by ts desc, l_partkey desc) - 1 as e from i),
  sp as (select o_custkey, l_partkey, ts, q, e < greatest(least(greatest(1, round_even(n * 0.2, 0)), n - 1), 0) as is_test from s)"""


def _interactions(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    joined = o.join(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_custkey", "l_partkey").agg(F.max("o_orderdate").alias("ts"), F.max("l_quantity").alias("q"))


@query(f"with {_SPLIT} select o_custkey, l_partkey, q, is_test from sp")
def temporal_split(t: Tables) -> DataFrame:
    return R.temporal_split(_interactions(t), "o_custkey", "ts", "l_partkey").select("o_custkey", "l_partkey", "q", "is_test")


@query(f"with {_SPLIT} select o_custkey, count(*)::bigint as n_train from sp where not is_test group by 1 having count(*) >= 5 order by md5('42:' || o_custkey), 1 limit 1500")
def eval_users(t: Tables) -> DataFrame:
    train = R.temporal_split(_interactions(t), "o_custkey", "ts", "l_partkey").filter("not is_test")
    return R.eligible_users(train, "o_custkey", 5, 1500)


@query(f"""with {_SPLIT}, top as (select l_partkey, row_number() over (order by count(*) desc, l_partkey) as pos from sp where not is_test group by 1 qualify pos <= 20),
  users as (select distinct o_custkey from sp), rel as (select o_custkey, l_partkey from sp where is_test and q >= 25),
  g as (select o_custkey, count(*) as g from rel group by 1),
  h as (select u.o_custkey, pos, (r.l_partkey is not null)::int as hit from users u cross join top left join rel r on r.o_custkey = u.o_custkey and r.l_partkey = top.l_partkey),
  c as (select *, sum(hit) over (partition by o_custkey order by pos) as cum from h),
  k as (select unnest([5, 10, 20])::int as k),
  m as (select k, c.o_custkey, coalesce(any_value(g), 0) as g, count(*) as n, sum(hit) as hits, sum(hit * cum / pos) as a, sum(hit / log2(pos + 1.0)) as d
    from k join c on pos <= k left join g on g.o_custkey = c.o_custkey group by 1, 2),
  v as (select k, hits / n as precision, coalesce(hits / nullif(g, 0), 0) as recall, (hits > 0)::int::double as hit, coalesce(a / nullif(least(g, k), 0), 0) as ap,
    coalesce(d / nullif(list_sum(list_transform(range(1, least(g, k) + 1), lambda i: 1 / log2(i + 1.0))), 0), 0) as ndcg from m)
  select k, count(*)::bigint as users, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(hit), 6) as hit, round(avg(ap), 6) as ap, round(avg(ndcg), 6) as ndcg from v group by 1""")
def ranking_metrics(t: Tables) -> DataFrame:
    """Popularity recommendations judged on what customers did last, for three K at once."""
    split = R.temporal_split(_interactions(t), "o_custkey", "ts", "l_partkey")
    n = split.filter("not is_test").groupBy("l_partkey").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "l_partkey").limit(20)
    top = top.select("l_partkey", F.row_number().over(Window.orderBy(F.desc("n"), "l_partkey")).alias("rank"))
    return R.shared_list_metrics(top, split, F.expr("is_test and q >= 25"), "o_custkey", "l_partkey", (5, 10, 20))


_CONTENT = f"""{_TFIDF}, {_SPLIT},
  users as (select o_custkey from sp where not is_test group by 1 having count(*) >= 5 order by md5('42:' || o_custkey), 1 limit 1500),
  mine as (select sp.* from sp join users using (o_custkey)),
  rel as (select o_custkey, l_partkey from mine where is_test and q >= 25),
  liked as (select o_custkey, l_partkey from mine where not is_test and q >= 25 and o_custkey in (select o_custkey from rel)),
  prof as (select o_custkey, term, sum(weight) as w from liked join triples on id = l_partkey group by 1, 2),
  unit as (select o_custkey, term, w / sqrt(sum(w * w) over (partition by o_custkey)) as w from prof),
  sc as (select o_custkey, id as l_partkey, round(sum(w * weight), 6) as score from unit join triples using (term) group by 1, 2),
  seen as (select o_custkey, l_partkey from mine where not is_test),
  rec as (select o_custkey, l_partkey, row_number() over (partition by o_custkey order by score desc, l_partkey) as pos from sc anti join seen using (o_custkey, l_partkey) qualify pos <= 20)"""


@query(f"""with {_CONTENT}, k as (select unnest([5, 10, 20])::int as k), sizes as (select o_custkey, count(*) as g from rel group by 1),
  h as (select rec.o_custkey, pos, (rel.l_partkey is not null)::int as hit from rec left join rel using (o_custkey, l_partkey)),
  c as (select *, sum(hit) over (partition by o_custkey order by pos) as cum from h),
  m as (select k, c.o_custkey, any_value(g) as g, count(*) as n, sum(hit) as hits, sum(hit * cum / pos) as a, sum(hit / log2(pos + 1.0)) as d from k join c on pos <= k join sizes on sizes.o_custkey = c.o_custkey group by 1, 2),
  v as (select k, hits / n as precision, hits / g as recall, (hits > 0)::int::double as hit, a / least(g, k) as ap, d / list_sum(list_transform(range(1, least(g, k) + 1), lambda i: 1 / log2(i + 1.0))) as ndcg from m)
  select k, count(*)::bigint as users, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(hit), 6) as hit, round(avg(ap), 6) as ap, round(avg(ndcg), 6) as ndcg from v group by 1""")
def content_evaluation(t: Tables) -> DataFrame:
    """Content-based recommendations of the evaluated users judged on what they did last.

    The profile of a user is the mean vector of what they liked in training; all that they
    met in training is left out. Users without liked history or relevant test items are skipped.
    """
    return R.ranking_metrics(*_content_lists(t), "o_custkey", "l_partkey", (5, 10, 20))


@query(f"with {_CONTENT} select o_custkey, l_partkey, (select score from sc where sc.o_custkey = rec.o_custkey and sc.l_partkey = rec.l_partkey) as score, pos::int as rank from rec")
def content_recommendations(t: Tables) -> DataFrame:
    """The twenty best unseen parts of every evaluated user."""
    return _content_lists(t)[0]


def _content_lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(recommendations, relevant test items) of the evaluated users."""
    folder = t.scratch("content")
    R.temporal_split(_interactions(t), "o_custkey", "ts", "l_partkey").write.parquet(f"{folder}/split")
    split = t.spark.read.parquet(f"{folder}/split")
    users = R.eligible_users(split.filter("not is_test"), "o_custkey", 5, 1500).select("o_custkey")
    split.join(F.broadcast(users), "o_custkey", "left_semi").write.parquet(f"{folder}/mine")
    mine = t.spark.read.parquet(f"{folder}/mine")
    relevant = mine.filter("is_test and q >= 25").select("o_custkey", "l_partkey")
    liked = mine.filter("not is_test and q >= 25").select("o_custkey", "l_partkey").join(relevant, "o_custkey", "left_semi")
    _triples(t).withColumnRenamed("p_partkey", "l_partkey").write.parquet(f"{folder}/triples")
    triples = t.spark.read.parquet(f"{folder}/triples")
    SM.profiles(triples, liked, "o_custkey", "l_partkey").write.parquet(f"{folder}/profiles")
    profiles = t.spark.read.parquet(f"{folder}/profiles")
    seen = mine.filter("not is_test").select("o_custkey", "l_partkey")
    recs = sparse_top_k(profiles, triples, "o_custkey", "l_partkey", 20, exclude=seen)
    return recs, relevant.join(profiles.select("o_custkey").distinct(), "o_custkey", "left_semi")


@query("""select d.doc_id, d.lang, s.n::bigint as source_docs from documents d join (select source, count(*) as n from documents group by 1) s using (source)
  where s.n >= (select avg(n) from (select count(*) as n from documents group by source))""")
def popular_sources(t: Tables) -> DataFrame:
    """Rows of sources with at least the mean number of documents."""
    n = S.popularity(t.documents, "source", "n_chars").select("source", F.col("rating_count").alias("source_docs"))
    enough = n.withColumn("_m", F.avg("source_docs").over(Window.partitionBy())).filter("source_docs >= _m").drop("_m")
    return t.documents.select("doc_id", "lang", "source").join(enough, "source").drop("source")
