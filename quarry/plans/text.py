"""Queries over texts: tokens, frequencies, keywords, co-occurrence and chunk quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import textstats as S
from quarry.plans._registry import Registry
from quarry.session import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_VERBS = ", ".join(f"'{w}'" for w in T.STOP_VERBS)
_DOCS = "documents"


@_r.query("f1_ascii_tokens", "select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_distinct, t[1] as first_token from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents)")
def f1_ascii_tokens(spark, sf_dir):
    t = T.ascii_tokens(F.col("text"))
    return table(spark, sf_dir, _DOCS).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.get(t, F.lit(0)).alias("first_token"))


@_r.query("f2_unicode_tokens", r"select doc_id, len(t)::int as n_tokens, t[-1] as last_token from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as t from documents)")
def f2_unicode_tokens(spark, sf_dir):
    t = T.unicode_tokens(F.col("text"))
    return table(spark, sf_dir, _DOCS).select("doc_id", F.size(t).alias("n_tokens"), F.try_element_at(t, F.lit(-1)).alias("last_token"))


@_r.query("f3_terms", rf"select doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]{{2,}}'), lambda w: w not in ({_VERBS})))) as terms from documents")
def f3_terms(spark, sf_dir):
    found = F.array_distinct(F.filter(T.terms(F.col("text")), lambda w: ~w.isin(T.STOP_VERBS)))
    return table(spark, sf_dir, _DOCS).select("doc_id", F.array_sort(found).alias("terms"))


@_r.query("f5_char_shingles", r"""
with n as (select doc_id, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') as f from documents where doc_id % 1 = 0)
select doc_id, case when length(f) < 5 then 1 else len(list_distinct(list_transform(range(1, length(f) - 3), lambda i: substr(f, i, 5)))) end::int as n_shingles from n""".replace(" where doc_id % 1 = 0", ""))
def f5_char_shingles(spark, sf_dir):
    return table(spark, sf_dir, _DOCS).select("doc_id", F.size(T.char_shingles(F.col("text"))).alias("n_shingles"))


@_r.query("f6_word_shingles", """
with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents)
select doc_id, len(list_distinct(case when len(t) < 4 then t else list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' ')) end))::int as n_shingles from t""")
def f6_word_shingles(spark, sf_dir):
    split = table(spark, sf_dir, _DOCS).select("doc_id", T.ascii_tokens(F.col("text")).alias("t"))
    return split.select("doc_id", F.size(T.word_shingles(F.col("t"))).alias("n_shingles"))


@_r.query("f19_titles", r"""
select doc_id, coalesce(nullif(trim(regexp_extract(trim(text), '(?m)^#{1,6}\s+(.+)$', 1)), ''),
  nullif(substr(trim(regexp_extract(trim(text), '(?s)^(.*?[.!?])\s', 1)), 1, 120), ''), nullif(substr(trim(text), 1, 120), ''), substr(trim(text), 1, 80)) as title from documents""")
def f19_titles(spark, sf_dir):
    return table(spark, sf_dir, _DOCS).select("doc_id", T.title(F.col("text")).alias("title"))


@_r.query("f30_sentences", r"""
select doc_id, len(s)::int as n_sentences, s[1] as first_sentence from (
  select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '') as s from documents)""")
def f30_sentences(spark, sf_dir):
    found = table(spark, sf_dir, _DOCS).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


@_r.query("f18_coherence", r"""
with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 3) as w from documents),
r as (select doc_id, len(w) as n, len(list_distinct(w)) / greatest(len(w), 1)::double as ttr from w)
select doc_id, round(case when n < 4 then 1.0 when ttr < 0.3 then ttr / 0.3 when ttr > 0.7 then (1 - ttr) / 0.3 else 1.0 end, 3)::double as coherence from r""")
def f18_coherence(spark, sf_dir):
    return table(spark, sf_dir, _DOCS).select("doc_id", T.type_token_coherence(F.col("text")).alias("coherence"))


@_r.query("a1_event_counts", """
select 'event_type' as dimension, event_type as value, count(*) as n, round(sum(value), 4) as amount from events group by all
union all select 'user_id', user_id::varchar, count(*), round(sum(value), 4) from events group by all
union all select 'total', null, count(*), round(sum(value), 4) from events""")
def a1_event_counts(spark, sf_dir):
    out = S.counts_by(table(spark, sf_dir, "events"), "event_type", "user_id", measure=F.col("value"))
    return out.withColumn("amount", F.round("amount", 4))


@_r.query("a1_order_rollup", """
select o_orderstatus, o_orderpriority, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)""")
def a1_order_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_r.query("a4_term_frequencies", """
with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as l from documents)
select doc_id, term, count(*) as n, round(count(*) / any_value(l)::double, 9) as tf from t group by doc_id, term""")
def a4_term_frequencies(spark, sf_dir):
    return S.term_frequencies(table(spark, sf_dir, _DOCS), "doc_id", "text").withColumn("tf", F.round("tf", 9))


@_r.query("a5_document_frequencies", """
with t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents)
select term, count(*) as df, round(ln(((select count(*) from documents) + 1) / (count(*) + 1)::double) + 1, 9) as idf from t group by term""")
def a5_document_frequencies(spark, sf_dir):
    docs = table(spark, sf_dir, _DOCS)
    return S.inverse_document_frequencies(S.term_frequencies(docs, "doc_id", "text"), docs.count()).withColumn("idf", F.round("idf", 9))


@_r.query("a6_stop_terms", r"""
with t as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) as term from documents),
c as (select term, count(*) as df from t where term <> '' group by term)
select term, df from (select *, row_number() over (order by df desc, term) as r from c) where r <= (select greatest(1, ceil(count(*) * 0.1)) from c)""")
def a6_stop_terms(spark, sf_dir):
    return S.stop_terms(table(spark, sf_dir, _DOCS), "text")


#: Terms of taxonomies are in two of a hundred documents at least.
SHARE = 0.02
PAIRS_SQL = rf"""
with d as (select doc_id, text from documents), n as (select count(*)::double as n from d),
s as (select distinct doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]{{2,}}'), lambda w: w not in ({_VERBS}))) as term from d),
o as (select term, count(*) as f from s group by term having count(*) >= greatest(2, (select ceil({SHARE} * n) from n))),
k as (select s.* from s join o using (term)),
p as (select a.term as term_a, b.term as term_b, count(*) as n from k a join k b on a.doc_id = b.doc_id and a.term < b.term group by all),
q as (select p.*, x.f as fa, y.f as fb, t.n as total, log2(p.n / t.n / ((x.f / t.n) * (y.f / t.n))) as pmi from p join o x on x.term = term_a join o y on y.term = term_b, n t),
r as (select *, case when n = total then 1.0 else pmi / -log2(n / total) end as npmi from q where pmi >= 0.1),
u as (select case when fa >= fb then term_b else term_a end as child, arg_min(case when fa >= fb then term_a else term_b end, (-round(npmi, 9), term_a, term_b)) as parent,
  arg_min(npmi, (-round(npmi, 9), term_a, term_b)) as npmi from r group by 1)
"""


@_r.query("a7_pmi_pairs", PAIRS_SQL + "select term_a, term_b, n, round(pmi, 6) as pmi, round(npmi, 6) as npmi from r")
def a7_pmi_pairs(spark, sf_dir):
    """Pairs of terms of all documents that occur together more than by chance."""
    pairs = S.pmi_pairs(table(spark, sf_dir, _DOCS), "doc_id", "text", min_share=SHARE)
    return pairs.select("term_a", "term_b", "n", F.round("pmi", 6).alias("pmi"), F.round("npmi", 6).alias("npmi"))


#: The same of all terms of two documents or more.
_ALL_PAIRS_SQL = PAIRS_SQL.replace(f"greatest(2, (select ceil({SHARE} * n) from n))", "2")


@_r.query("a8_taxonomy_parents", _ALL_PAIRS_SQL + "select child, parent, round(npmi, 6) as npmi from u")
def a8_taxonomy_parents(spark, sf_dir):
    """Each term of the documents below the commoner one that it keeps company with."""
    return S.best_parents(table(spark, sf_dir, _DOCS), "doc_id", "text").withColumn("npmi", F.round("npmi", 6))


@_r.query("a23_keywords", rf"""
with t as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]{{2,}}'), lambda w: w not in ({_STOP})) as t from documents),
e as (select doc_id, unnest(t) as term, generate_subscripts(t, 1) as pos from t),
c as (select doc_id, term, count(*) as n, min(pos) as f from e group by all),
r as (select *, row_number() over (partition by doc_id order by n desc, f) as r from c)
select d.doc_id, coalesce(k.keywords, []::varchar[]) as keywords from documents d
left join (select doc_id, list(term order by r) as keywords from r where r <= 5 group by doc_id) k using (doc_id)""")
def a23_keywords(spark, sf_dir):
    return S.keywords(table(spark, sf_dir, _DOCS), "doc_id", "text")


@_r.query("w9_top_terms", """
with t as (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents)
select term, count(*) as n from t group by term order by n desc, term limit 20""")
def w9_top_terms(spark, sf_dir):
    rows = table(spark, sf_dir, _DOCS).select(F.explode(T.ascii_tokens(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)
