"""Queries on text: cleaning, tokens, n-grams, dictionaries, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import substrings as SS
from ..operators import text as OT
from .registry import ORACLE_SQL, Tables, query

_S = r"[ \t\n\x0B\f\r]"
_NS = r"[^ \t\n\x0B\f\r]"


def _chain(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column


def _collapse(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '{_S}+', ' ', 'g'), ' ')"


_TRAIN = _collapse(
    _chain("lower(coalesce({c}, ''))", [("<[^>]+>", " "), (f"http{_NS}+|www\\.{_NS}+", " "), (f"{_NS}+@{_NS}+\\.{_NS}+", " "),
           (r"[!-/:-@\[-`{{-~]", " "), ("[0-9]+", " "), (r"[^a-zA-Z \t\n\x0B\f\r]", " "), (r"[^\x00-\x7F]+", " ")])
)


@query(f"select page_id, {_TRAIN.format(c='html')} as clean from pages")
def html_clean(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.clean_news_train(F.col("html")).alias("clean"))


@query(f"select doc_id, md5({_TRAIN.format(c='text')}) as clean_md5 from documents")
def clean_news_train(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.clean_news_train(F.col("text"))).alias("clean_md5"))


_SERVE = _collapse(_chain("lower(coalesce(text, ''))", [(f"http{_NS}+|www{_NS}+", ""), (f"{_NS}+@{_NS}+", ""), (r"[^a-zA-Z \t\n\x0B\f\r]", "")]))


@query(f"select doc_id, md5(array_to_string(list_filter(string_split({_SERVE}, ' '), lambda w: length(w) > 2), ' ')) as clean_md5 from documents")
def clean_news_serve(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.clean_news_serve(F.col("text"))).alias("clean_md5"))


_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_DESK = _collapse(
    _chain(_collapse(f"regexp_replace(lower(coalesce(text, '')), '{_CTRL}', '', 'g')"),
           [(r"\?+ *$", ""), ("!{2,}", "!"), (r"\.{2,}", "."), (r"[^a-z0-9 \t\n\x0B\f\r''-]", "")])
)


@query(f"select conv_id, turn, {_DESK} as clean from conversations")
def clean_helpdesk(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.clean_helpdesk(F.col("text")).alias("clean"))


_CURLY, _PLAIN = "\u2019\u2018\u201c\u201d\u2013\u2014\u00a0", "\'\'\"\"-- "
_MARKS = " \u2019x\u2019 \u201cy\u201d\u2013\u2014\u00a0z"
_PLAINED = f"translate(coalesce(text, '') || '{_MARKS}', '{_CURLY}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')"


@query("select conv_id, turn, " + _collapse(f"regexp_replace({_PLAINED}, '{_CTRL}', '', 'g')") + " as clean from conversations")
def typographic_clean(t: Tables) -> DataFrame:
    marked = F.concat(F.coalesce("text", F.lit("")), F.lit(_MARKS))
    return t.conversations.select("conv_id", "turn", X.typographic(marked).alias("clean"))


def _contracted(sql: str) -> str:
    for short, full in X.CONTRACTIONS.items():
        sql = "replace({}, '{}', '{}')".format(sql, short.replace("'", "''"), full.replace("'", "''"))
    return sql


_SPOKEN = "text || ' I''m sure it''s the habit''s end, don''t'"
_TOKENS = (
    f"list_filter(list_transform(regexp_extract_all({_contracted('lower(' + _SPOKEN + ')')}, '[a-z0-9'']+'), lambda w: trim(w, '''')), "
    "lambda w: regexp_matches(w, '^[a-z0-9]+$'))"
)
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def _spoken() -> Column:
    return F.concat("text", F.lit(" I'm sure it's the habit's end, don't"))


@query(f"select conv_id, turn, array_to_string({_TOKENS}, ' ') as tokens from conversations")
def tokenise(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(X.tokenize(_spoken()), " ").alias("tokens"))


@query(f"""select conv_id, turn, array_to_string(list_filter({_TOKENS}, lambda w: not list_contains({_STOP}, w)), ' ') as filtered,
  array_to_string(list_filter({_TOKENS}, lambda w: (w in ('not', 'no', 'never') or not list_contains({_STOP}, w)) and length(w) > 1), ' ') as news from conversations""")
def stopword_filter(t: Tables) -> DataFrame:
    tokens = X.tokenize(_spoken())
    return t.conversations.select(
        "conv_id", "turn", F.array_join(X.remove_stopwords(tokens), " ").alias("filtered"),
        F.array_join(X.remove_stopwords(tokens, X.NEGATIONS, 2), " ").alias("news"),
    )


def _lemma_sql(w: str) -> str:
    """Written apart from the endings of the function, by suffixes and lengths."""
    plain = f"right({w}, 2) in ('ss', 'us', 'is')"
    es = f"(right({w}, 4) in ('ches', 'shes', 'sses', 'zzes') or right({w}, 3) = 'xes')"
    return f"""case when {plain} then {w} when length({w}) >= 5 and {es} then left({w}, -2) when length({w}) >= 5 and right({w}, 3) = 'ies' then left({w}, -3) || 'y'
    when length({w}) >= 4 and right({w}, 1) = 's' then left({w}, -1) else {w} end"""


@query(f"""with w as (select conv_id, turn, {_TOKENS} as ws from conversations)
  select conv_id, turn, array_to_string(list_transform(ws, lambda w: {_lemma_sql('w')}), ' ') as lemmas from w""")
def lemmatise(t: Tables) -> DataFrame:
    """Tokens without their plural endings."""
    rows = t.conversations.select("conv_id", "turn", X.tokenize(_spoken()).alias("ws"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("ws", X.lemma), " ").alias("lemmas"))


@query(r"select doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*'), ' ')) as normal_md5 from documents")
def normalize_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("normal_md5"))


@query(f"""with c as (select doc_id, {_collapse("coalesce(text, '')")} as t from documents), w as (select doc_id, t, list_filter(string_split(t, ' '), lambda x: x <> '') as ws from c)
  select doc_id, len(ws)::int as word_count, length(t)::int as char_count,
  len(list_filter(string_split_regex(t, '[.!?]+'), lambda x: trim(x) <> ''))::int as sentence_count,
  round(case when len(ws) > 0 then list_sum(list_transform(ws, lambda x: length(x)))::double / len(ws) else 0 end, 2) as avg_word_length from w""")
def text_stats(t: Tables) -> DataFrame:
    return OT.text_stats(t.documents, "doc_id", "text")


@query("""select doc_id, (n >= 20 and n <= 50000) as is_article, (n >= 1 and n <= 500) as is_query from (
  select doc_id, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) as n from documents)""".replace("\\\\", "\\"))
def text_validity(t: Tables) -> DataFrame:
    n = F.length(X.strip(F.coalesce("text", F.lit(""))))
    return t.documents.select("doc_id", n.between(20, 50_000).alias("is_article"), n.between(1, 500).alias("is_query"))


#: Keywords of the invented conversations, by entity.
VOCABULARY = {
    "article": ("the", "an"), "place": ("in", "on", "at"), "copula": ("is", "are", "was"), "origin": ("from", "of"),
    "pair": ("of the", "in the"), "rare": ("thanonre", "erinble"),
}


def _entity(e: str, kws: tuple[str, ...]) -> str:
    return f"case when regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(kws)})($|[^\\p{{L}}\\p{{N}}_])') then '{e}' end"


@query("select conv_id, turn, array_to_string(list_filter([" + ", ".join(_entity(e, k) for e, k in VOCABULARY.items()) + "], lambda x: x is not null), ',') as entities from conversations")
def entity_scan(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(X.extract_entities(F.col("text"), VOCABULARY), ",").alias("entities"))


_LABELS = "case event_id % 5 when 0 then ' Password  Reset ' when 1 then 'WiFi_problem' when 2 then 'laptop-issue!' when 3 then 'hr_'||event_type else event_type end"
_SNAKE = _chain(f"lower(trim({_LABELS}))", [(_S + "+", "_"), ("[^a-z0-9_]", ""), ("_+", "_"), ("^_+|_+$", "")])


@query(f"""with s as (select event_id, {_SNAKE} as v from events) select event_id,
  case v {' '.join(f"when '{a}' then '{b}'" for a, b in X.INTENT_ALIASES.items())} else v end as intent,
  case when list_contains([{', '.join(f"'{e}'" for e in X.ENTITIES)}], v) then v else coalesce(list_filter([{', '.join(f"'{e}'" for e in X.ENTITIES)}], lambda e: starts_with(v, e || '_'))[1], v) end as entity from s""")
def intent_normalise(t: Tables) -> DataFrame:
    label = F.expr(_LABELS)
    return t.events.select("event_id", X.normalize_intent(label).alias("intent"), X.normalize_entity(label).alias("entity"))


_KEYWORDS = (("greeting", "the"), ("greeting", "and"), ("request", "tion"), ("request", "ing"), ("other", "zzz"))


@query("select k.intent, k.keyword, (select count(*) from conversations where contains(lower(text), k.keyword))::bigint as n from (values "
       + ", ".join(f"('{a}', '{b}')" for a, b in _KEYWORDS) + ") k(intent, keyword)")
def keyword_scan_join(t: Tables) -> DataFrame:
    return OT.keyword_counts(t.conversations, "text", _KEYWORDS)


_GRAM_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*')"


def _gram_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"select toxic, {n} as n, unnest(list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: {gram})) as gram from t"


@query(f"""with t as (select toxic, {_GRAM_TOKENS} as w from documents join labels using (doc_id)),
  g as ({' union all '.join(_gram_sql(n) for n in (1, 2, 3))}),
  c as (select toxic, n, gram, count(*)::bigint as freq, row_number() over (partition by toxic, n order by count(*) desc, gram) as rank from g group by 1, 2, 3)
  select toxic, n::int as n, gram, freq, rank::int as rank from c where rank <= 20""")
def ngrams_top_by_label(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "toxic"), "doc_id")
    return OT.top_ngrams(docs, "toxic", X.normal_tokens(F.col("text")), (1, 2, 3), 20)


@query(f"""with w as (select lang, unnest({_GRAM_TOKENS}) as w from documents)
  select lang, count(distinct w)::bigint as vocabulary, count(*)::bigint as tokens from w group by 1""")
def vocabulary(t: Tables) -> DataFrame:
    words = t.documents.select("lang", F.explode(X.normal_tokens(F.col("text"))).alias("w"))
    per = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    return per.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("tokens"))


@query(f"""with r as (select role, text, regexp_extract_all(lower(text), '[a-z0-9'']+') as tok from conversations where text is not null),
  f as (select *, list_filter(tok, lambda w: not list_contains({_STOP}, w)) as kept from r)
  select count(*)::bigint as questions, round(avg(length(text)), 4) as avg_chars, round(avg(len(tok)), 4) as avg_tokens,
  round(avg(len(tok) - len(kept)), 4) as avg_stopwords, (select count(distinct w) from (select unnest(tok) as w from f))::bigint as raw_vocabulary,
  (select count(distinct w) from (select unnest(kept) as w from f))::bigint as kept_vocabulary, (count(*) - count(distinct text))::bigint as duplicate_questions from f""")
def nlp_stats(t: Tables) -> DataFrame:
    return OT.corpus_stats(t.conversations.filter("text is not null"), "text")


@query("""select p_partkey, title, case when p_partkey % 4 = 0 then null else 1950 + (p_partkey % 70)::int end as year,
  case when p_partkey % 4 = 0 then title else p_name end as bare from (select *, case when p_partkey % 4 = 0 then p_name || ' (x)' else p_name || ' (' || (1950 + p_partkey % 70) || ')' end as title from part)""")
def release_year(t: Tables) -> DataFrame:
    title = F.expr("case when p_partkey % 4 = 0 then p_name || ' (x)' else p_name || ' (' || (1950 + p_partkey % 70) || ')' end")
    rows = t.part.select("p_partkey", title.alias("title"))
    return rows.select("p_partkey", "title", X.release_year(F.col("title")).alias("year"), X.strip_release_year(F.col("title")).alias("bare"))


@query("""select o_orderkey, case when o_orderkey % 3 = 2 then null else year(o_orderdate)::int end as year, case when o_orderkey % 3 = 2 then null else month(o_orderdate)::int end as month from orders""")
def date_parse(t: Tables) -> DataFrame:
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMMM d, yyyy"))
    written = written.when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d-MMM-yy")).otherwise(F.lit("no date"))
    parsed = X.parse_date(written)
    return t.orders.select("o_orderkey", F.year(parsed).alias("year"), F.month(parsed).alias("month"))


@query("""select lang, text_words, n from (select lang, array_to_string(string_split(text, ' ')[1:3], ' ') as text_words, count(*)::bigint as n,
  row_number() over (partition by lang order by count(*) desc, array_to_string(string_split(text, ' ')[1:3], ' ')) as r from documents group by 1, 2) where r <= 5""")
def opening_words(t: Tables) -> DataFrame:
    """The most frequent openings of each language."""
    opening = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    n = t.documents.groupBy("lang", opening.alias("text_words")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "text_words"))
    return n.withColumn("r", rank).filter("r <= 5").drop("r")


_NEEDLES = ("ring", "small r", "x", "ol", "STEEL", "zzz", "a")


@query(f"""select lower(n) as needle, p_partkey, p_name from part, (select unnest({list(_NEEDLES)}) as n) where contains(lower(p_name), lower(n))""")
def gram_search(t: Tables) -> DataFrame:
    """Parts by several needles over an index of grams, of one and two characters too."""
    parts, folder = t.part.select("p_partkey", "p_name"), t.scratch("grams")
    SS.write_gram_index(parts, "p_partkey", "p_name", folder)
    needles = t.spark.createDataFrame([(n,) for n in _NEEDLES], "needle string")
    return SS.search_all(parts, "p_partkey", "p_name", folder, needles)


@query("""with kw as (select distinct w as keyword from (select unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as w from benchmark)),
  t as (select conv_id * 1000 + turn as id, lower(text) as x from conversations where text is not null)
  select keyword, count(*)::bigint as n_texts from kw join t on contains(x, keyword) group by 1""")
def keyword_table_join(t: Tables) -> DataFrame:
    """Every long word of the benchmark as a keyword, with the turns of conversations it stands in."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)
    keywords = t.benchmark.select(F.explode(found).alias("keyword"))
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    met = SS.keyword_matches(turns, "id", "text", keywords)
    return met.select("keyword", "id").distinct().groupBy("keyword").agg(F.count("*").alias("n_texts"))


@query(f"""with f as (select 'intent' as kind, intent as value from ({ORACLE_SQL["intent_normalise"]}) union all select 'entity', entity from ({ORACLE_SQL["intent_normalise"]}))
  select kind, coalesce(value, '') as value, count(*)::bigint as n, round(count(*)::double / sum(count(*)) over (partition by kind), 6) as share from f group by 1, 2""")
def label_frequencies(t: Tables) -> DataFrame:
    """How often each intent and each entity occurs, and its share of its kind."""
    return OT.value_frequencies(intent_normalise(t.spark, t.sf_dir), ("intent", "entity"))
