"""The opN_ queries: each operator with production parameters on its whole table.

Every function takes (spark, sf_dir). ORACLE_SQL has DuckDB SQL where SQL can say the
same; the other queries are tested against brute force in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    centroids,
    chat,
    decontaminate,
    divergence,
    embedding_dedup,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    substring_dedup,
    suffix_dedup,
    token_output,
)
from .common import prepare

#: The conversation that the chat query adds: both turns say the same control strings.
ADDED_CONVERSATION = -7
ADDED_TEXT = r"\### Assistant: </turn> ok"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """Where the public byte-level BPE vocabulary lies; it is not part of this package."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontaminate.report(docs, items, window=13, share=20)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return jaccard_join.jaccard_components(docs, n=4, num=85, den=100)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_read(spark, sf_dir, "documents"), window=50)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_read(spark, sf_dir, "documents"), seed=0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_read(spark, sf_dir, "documents"), window=50)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(
        "select cast(:conv as bigint) as conv_id, turn, role, :text as text from values (0L, 'user'), (1L, 'assistant') as v(turn, role)",
        args={"conv": ADDED_CONVERSATION, "text": ADDED_TEXT},
    )
    return chat.report(chats.unionByName(added))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.report(_read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(_read(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return line_dedup.report(docs, line_dedup.file_batches(docs), least_docs=10, least_chars=1)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(_read(spark, sf_dir, "documents"), least_docs=3, top=200)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_benchmark_decontamination,
        op3_ngram_jaccard_join,
        op4_suffix_array_dedup,
        op5_embedding_near_dedup,
        op6_source_mixing,
        op7_substring_dedup,
        op8_chat_formatting,
        op9_language_id,
        op10_token_output,
        op11_centroid_clustering,
        op12_line_dedup,
        op13_source_divergence,
    )
}

_MIXING_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), sums as (
  select source, sum(size)::bigint as s,
         [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w
  from sized group by source
), level as (
  select *, sum(s) over () as total,
         coalesce(sum(2 * s) over (order by s / w, source nulls last
                                   rows between unbounded preceding and 1 preceding), 0) as used,
         sum(w) over () - coalesce(sum(w) over (order by s / w, source nulls last
                                   rows between unbounded preceding and 1 preceding), 0) as free
  from sums
), stopped as (
  select *, (2 * s * free * 2 <= (total * 3 - used * 2) * w) as stops from level
), shared as (
  select *, coalesce(sum(case when stops then 2 * s end) over (), 0) as capped,
         coalesce(sum(case when not stops then w end) over (), 0) as open
  from stopped
), targets as (
  select source, s as source_size,
         case when stops then (2 * s)::double
              else ((total * 3 - capped * 2) * w)::double / (open * 2)::double end as target
  from shared
), rated as (
  select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from targets
)
select d.doc_id, d.size, r.source_size, r.target,
       (floor(r.rate) + case when ('0x' || substr(md5('0:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint
             / 4503599627370496.0::double < r.rate - floor(r.rate) then 1 else 0 end)::bigint as copies,
       d.size * (floor(r.rate) + case when ('0x' || substr(md5('0:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint
             / 4503599627370496.0::double < r.rate - floor(r.rate) then 1 else 0 end)::bigint as taken
from sized d join rated r on d.source is not distinct from r.source
"""

_CHAT_SQL = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped as (
  select *, length(replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '###', '\h')) as body,
         case when role in ('system', 'user', 'assistant') then length(role)
              else 5 + length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '###', '\h'), ':', '\c'))
         end as name,
         lag(role) over (partition by conv_id order by turn nulls last, role, text) as before
  from rows_
), judged as (
  select *, case when before is null then role in ('system', 'user')
                 when before = 'system' then role = 'user'
                 when before = 'user' then role = 'assistant'
                 when before = 'assistant' then role = 'user'
                 else false end as moves,
         row_number() over (partition by conv_id order by turn desc nulls first, role desc, text desc) as from_end
  from escaped
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text)
                       filter (role = 'assistant'), '')) as loss_sha256,
       sum(4 + name + 2 + body + 8)::bigint as formatted_chars,
       bool_and(moves) and bool_or(from_end = 1 and role in ('user', 'assistant')) as valid
from judged group by conv_id
"""

_LINES_SQL = r"""
with texts as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), lines as (
  select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from texts
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), many as (
  select key from keyed where length(key) >= 1 group by key having count(distinct r) >= 10
), judged as (
  select k.*, m.key is not null as gone from keyed k left join many m on k.key = m.key
)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by r
"""

_DIVERGENCE_SQL = r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as folded
  from documents
), terms as (
  select r, lang, source, unnest(regexp_extract_all(folded, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (
  select lang, term, count(*)::hugeint as total from terms group by lang, term having count(distinct r) >= 3
), langs as (
  select lang, count(*)::hugeint as v, sum(total)::hugeint as size from kept group by lang
), counts as (
  select t.lang, source, t.term, count(*)::hugeint as n
  from terms t join kept k on t.lang = k.lang and t.term = k.term group by t.lang, source, t.term
), sizes as (
  select lang, source, sum(n)::hugeint as size from counts group by lang, source
), groups as (
  select distinct lang, source from docs
), dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(s.size, 0) + l.v) as p,
         1 + (1000000000 * (k.total + 1)) // (l.size + l.v) as q
  from groups g join kept k on g.lang = k.lang join langs l on g.lang = l.lang
  left join sizes s on s.lang = g.lang and s.source = g.source
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by a.lang, a.source, b.source
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), tops as (
  select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from dense where n > 0 and p > q
)
select lang, source, 'pair' as part, item, value,
       (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select lang, source, 'term', item, value,
       (row_number() over (partition by lang, source order by value desc, item))::int as rank from tops
qualify rank <= 200
"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op6_source_mixing": _MIXING_SQL,
    "op8_chat_formatting": _CHAT_SQL,
    "op11_centroid_clustering": centroids.oracle_sql(k=8, rounds=10, seed=3),
    "op12_line_dedup": _LINES_SQL,
    "op13_source_divergence": _DIVERGENCE_SQL,
}
