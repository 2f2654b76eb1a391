"""Queries on duplicates and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import dedup, search
from quarry.plans._registry import Registry
from quarry.session import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_EXACT = "with h as (select doc_id, sha256(text) as sha256, min(doc_id) over (partition by sha256(text)) as f from documents) "


@_r.query("f12_exact_dedup", _EXACT + "select doc_id, sha256, doc_id <> f as is_duplicate, case when doc_id <> f then f end as duplicate_of from h")
def f12_exact_dedup(spark, sf_dir):
    return dedup.exact_decisions(table(spark, sf_dir, "documents"), "doc_id", "text")


@_r.query("a2_dedup_stats", _EXACT + "select count(*) as total, sum((doc_id <> f)::int)::bigint as duplicates, sum((doc_id = f)::int)::bigint as canonical, round(avg((doc_id <> f)::int), 4) as duplicate_rate from h")
def a2_dedup_stats(spark, sf_dir):
    return dedup.duplicate_stats(dedup.exact_decisions(table(spark, sf_dir, "documents"), "doc_id", "text"))


_SHINGLED = """
with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
s as (select doc_id, list_distinct(case when len(t) < 4 then t else list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' ')) end) as s from t),
"""
#: Signatures by universal hashes of one base hash, a list of 128.
SIGNED = (
    _SHINGLED + "h as (select doc_id, list_transform(s, lambda x: ('0x' || substr(md5(x), 25, 8))::bigint) as h from s),\n"
    f"f as (select {[a for a, _ in dedup.FAMILY[:128]]} as ma, {[b for _, b in dedup.FAMILY[:128]]} as mb),\n"
    f"g as (select doc_id, list_transform(range(1, 129), lambda i: coalesce(list_min(list_transform(h, lambda x: (x * ma[i] + mb[i]) % {dedup.PRIME})), {dedup.PRIME})) as signature from h, f)\n"
)


@_r.query("f8_minhash", _SHINGLED + "g as (select doc_id, list_transform(range(0, 128), lambda seed: coalesce(list_min(list_transform(s, lambda x: substr(sha256(seed::varchar || ':' || x), 1, 16))), 'ffffffffffffffff')) as signature from s) select doc_id, signature from g")
def f8_minhash(spark, sf_dir):
    """The 128 MinHash values of every document's word shingles."""
    return dedup.signatures(table(spark, sf_dir, "documents"), "doc_id", "text")


@_r.query("f7_universal_minhash", SIGNED + "select doc_id, signature from g")
def f7_universal_minhash(spark, sf_dir):
    """The same by universal hashes."""
    return dedup.derived_signatures(table(spark, sf_dir, "documents"), "doc_id", "text")


@_r.query(
    "j4_lsh_pairs",
    SIGNED + """, r as (select min(doc_id) as rep, signature from g group by signature),
v as (select rep, unnest(range(0, 128)) as place, unnest(signature) as x from r),
p as (select x.rep as a, y.rep as b, count(*) / 128.0::double as similarity from v x join v y on x.place = y.place and x.x = y.x and x.rep < y.rep group by all)
select a, b, similarity from p where similarity >= 0.85 union all select rep, doc_id, 1.0::double from g join r using (signature) where doc_id <> rep""",
)
def j4_lsh_pairs(spark, sf_dir):
    """All pairs of signatures that agree on 85 per cent, for the least document of each, and that one with its others."""
    return dedup.lsh_pairs(dedup.derived_signatures(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", 0.85)


def simhash_sql() -> str:
    bit = lambda c, i: f"(case when sum(case when ({c} >> {i}) & 1 = 1 then 1 when {c} is null then 0 else -1 end) > 0 then {1 << i} else 0 end)"
    whole = lambda c: "(" + " + ".join(bit(c, i) for i in range(32)) + ")::bigint"
    return f"""
with t as (select doc_id, unnest(case when len(x) = 0 then [null] else x end) as t from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as x from documents)),
m as (select doc_id, ('0x' || substr(md5(t), 17, 8))::bigint as h, ('0x' || substr(md5(t), 25, 8))::bigint as l from t),
s as (select doc_id, {whole("h")} as hi, {whole("l")} as lo from m group by doc_id)
"""


@_r.query("f10_simhash", simhash_sql() + "select doc_id, hi, lo from s")
def f10_simhash(spark, sf_dir):
    """The SimHash of every document as two halves."""
    return dedup.simhash(table(spark, sf_dir, "documents"), "doc_id", "text")


@_r.query(
    "j5_simhash_pairs",
    simhash_sql() + ", r as (select hi, lo, min(doc_id) as rep from s group by all) select a.rep as a, b.rep as b, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::int as distance from r a join r b on a.rep < b.rep where bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3",
)
def j5_simhash_pairs(spark, sf_dir):
    """Pairs of different SimHashes at most three bits apart."""
    return dedup.simhash_pairs(dedup.simhash(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


#: One text after another, in the order of ids: accepted ids as a list, edges as each text's earlier neighbours.
_WALK = """,
o as materialized (select doc_id, row_number() over (order by doc_id) as n, min(doc_id) over (partition by text) as first from documents),
e as materialized (select b, list(a) as near from (select distinct a, b from p) group by b),
w as (select 0::bigint as n, []::bigint[] as held
  union all select o.n, case when o.first <> o.doc_id and list_contains(w.held, o.first) then w.held when list_has_any(coalesce(e.near, []), w.held) then w.held else list_append(w.held, o.doc_id) end
  from w join o on o.n = w.n + 1 left join e on e.b = o.doc_id),
k as materialized (select unnest(held) as id from (select held from w order by n desc limit 1)),
best as (select b as id, arg_min(struct_pack(a := a, s := s, how := how), struct_pack(o := o, s := -s, a := a)) as m from p where a in (from k) group by b)
select o.doc_id, o.doc_id not in (from k) as is_duplicate, case when o.doc_id in (from k) then null when o.first <> o.doc_id and o.first in (from k) then o.first else best.m.a end as duplicate_of,
  case when o.doc_id in (from k) then null when o.first <> o.doc_id and o.first in (from k) then 1.0 else best.m.s end::double as similarity,
  case when o.doc_id in (from k) then 'unique' when o.first <> o.doc_id and o.first in (from k) then 'exact' else best.m.how end as method
from o left join best on best.id = o.doc_id"""
_BANDED = """b as materialized (select doc_id, signature, unnest(range(0, 16)) as band, unnest(list_transform(range(0, 16), lambda i: array_to_string(signature[i*8+1:i*8+8], ','))) as key from g),
c as (select distinct x.doc_id as a, y.doc_id as b from b x join b y on x.band = y.band and x.key = y.key and x.doc_id < y.doc_id),
near as (select a, b, len(list_filter(range(1, 129), lambda i: x.signature[i] = y.signature[i])) / 128.0::double as s from c join g x on x.doc_id = a join g y on y.doc_id = b)"""


@_r.query("c1_greedy_dedup", SIGNED.replace("with ", "with recursive ", 1) + ", " + _BANDED + ", p as materialized (select a, b, s, 0 as o, 'near' as how from near where s >= 0.85)" + _WALK)
def c1_greedy_dedup(spark, sf_dir):
    """Decisions of a sequential MinHash index over all documents."""
    found = dedup.greedy_decisions(table(spark, sf_dir, "documents"), "doc_id", "text", sign=dedup.derived_signatures)
    return found.withColumnRenamed("id", "doc_id")


_CHARACTERS = (
    r"""with recursive n as (select doc_id, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') as f from documents),
s as (select doc_id, case when length(f) < 5 then [f] else list_distinct(list_transform(range(1, length(f) - 3), lambda i: substr(f, i, 5))) end as s from n),
""" + SIGNED[len(_SHINGLED) :].rstrip().replace("g as (", "g as materialized (")
)
_HASHED = simhash_sql().strip().removeprefix("with t as").replace("s as (select doc_id, (", "z as materialized (select doc_id, (")


@_r.query(
    "c2_cascade_dedup",
    _CHARACTERS + ", t as" + _HASHED + ", " + _BANDED + """, p as materialized (select a, b, s, 0 as o, 'near' as how from near where s >= 0.8
  union all select x.doc_id, y.doc_id, 0.9::double, 1, 'simhash' from z x join z y on x.doc_id < y.doc_id and bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 3)""" + _WALK,
)
def c2_cascade_dedup(spark, sf_dir):
    """Decisions by hash, then MinHash of characters, then SimHash."""
    return dedup.cascade_decisions(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.where("vec_id % 100 = 0")


_COSINE = """
with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 100 = 0), d as (select vec_id as id, embedding::double[] as v from embeddings),
s as (select query_id, id, list_cosine_similarity(q.v, d.v) as score from q, d)"""


@_r.query("t1_cosine_knn", _COSINE + " select query_id, id, round(score, 6) as score, r::int as rank from (select *, row_number() over (partition by query_id order by score desc, id desc) as r from s) where r <= 10")
def t1_cosine_knn(spark, sf_dir):
    """The ten most similar vectors of every hundredth, over all."""
    vectors, queries = _vectors(spark, sf_dir)
    return search.nearest(vectors, queries, "vec_id", "embedding")


@_r.query("t2_euclidean_knn", _COSINE.replace("list_cosine_similarity", "list_distance") + " select query_id, id, round(score, 6) as score, r::int as rank from (select *, row_number() over (partition by query_id order by score, id) as r from s) where r <= 10")
def t2_euclidean_knn(spark, sf_dir):
    """The ten nearest vectors of every hundredth, over all."""
    vectors, queries = _vectors(spark, sf_dir)
    return search.nearest(vectors, queries, "vec_id", "embedding", metric="euclidean")


@_r.query("t5_positive_dense", _COSINE + " select query_id, id, round(score, 6) as score, r::int as rank from (select *, row_number() over (partition by query_id order by score desc, id desc) as r from s where score > 0.2) where r <= 5")
def t5_positive_dense(spark, sf_dir):
    """At most five vectors of a similarity above 0.2."""
    vectors, queries = _vectors(spark, sf_dir)
    return search.nearest(vectors, queries, "vec_id", "embedding", k=5, least=0.2)


@_r.query("p4_filtered_knn", _COSINE.replace("from embeddings),", "from embeddings where label = 1),") + " select query_id, id, round(score, 6) as score, r::int as rank from (select *, row_number() over (partition by query_id order by score desc, id desc) as r from s) where r <= 5")
def p4_filtered_knn(spark, sf_dir):
    """The nearest vectors among those of a label: the filter goes before the ranking."""
    vectors, queries = _vectors(spark, sf_dir)
    return search.nearest(vectors.where("label = 1"), queries, "vec_id", "embedding", k=5)


_WEIGHTS = """
with dt as (select doc_id, unnest(t) as term, len(t) as l from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents)),
tf as (select doc_id, term, count(*) / any_value(l)::double as tf from dt group by doc_id, term),
idf as (select term, ln(((select count(*) from documents) + 1) / (count(*) + 1)::double) + 1 as idf from tf group by term),
w as (select doc_id, term, tf * idf as w, idf from tf join idf using (term)),
qt as (select item_id, unnest(t) as term, len(t) as l from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from benchmark)),
q as (select item_id as query_id, term, count(*) / any_value(l)::double as qw from qt group by item_id, term)"""


@_r.query(
    "t4_tfidf",
    _WEIGHTS + """, s as (select query_id, doc_id as id, round(sum(qw * w), 6) as score from q join w using (term) group by all)
select query_id, id, score, r::int as rank from (select *, row_number() over (partition by query_id order by score desc, id desc) as r from s where score > 0) where r <= 10""",
)
def t4_tfidf(spark, sf_dir):
    """The ten documents of highest TF-IDF score for every benchmark item."""
    return search.tfidf(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@_r.query(
    "t8_tfidf_cosine",
    _WEIGHTS + """, n as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id), qi as (select query_id, term, qw * idf as qw from q join idf using (term)),
qn as (select query_id, sqrt(sum(qw * qw)) as qnorm from qi group by query_id),
s as (select query_id, doc_id as id, round(sum(qw * w) / (any_value(norm) * any_value(qnorm)), 6) as score from qi join w using (term) join n using (doc_id) join qn using (query_id) group by query_id, doc_id)
select query_id, id, score, r::int as rank from (select *, row_number() over (partition by query_id order by score desc, id) as r from s where score > 0) where r <= 10""",
)
def t8_tfidf_cosine(spark, sf_dir):
    """The ten documents of highest TF-IDF cosine for every benchmark item."""
    return search.tfidf_cosine(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@_r.query(
    "t6_hybrid",
    _WEIGHTS + """, s as (select query_id, doc_id as id, round(sum(qw * w), 6) as score from q join w using (term) group by all),
sp as (select query_id, id, score from (select *, row_number() over (partition by query_id order by score desc, id desc) as r from s where score > 0) where r <= 40),
qv as (select item_id as query_id, embedding::double[] as v from benchmark join embeddings on item_id = vec_id),
dv as (select vec_id as id, embedding::double[] as v from embeddings join documents on doc_id = vec_id),
ds as (select query_id, id, list_cosine_similarity(qv.v, dv.v) as raw from qv, dv),
de as (select query_id, id, round(raw, 6) as score from (select *, row_number() over (partition by query_id order by raw desc, id desc) as r from ds where raw > 0) where r <= 40),
b as (select coalesce(sp.query_id, de.query_id) as query_id, coalesce(sp.id, de.id) as id, sp.score as s, de.score as d from sp full join de on sp.query_id = de.query_id and sp.id = de.id),
m as (select *, max(s) over (partition by query_id) as ms, max(d) over (partition by query_id) as md from b),
x as (select query_id, id, round(case when ms is not null and md is not null then 0.4 * coalesce(s / ms, 0) + 0.6 * coalesce(d / md, 0) else coalesce(s, d) end, 6) as score from m)
select query_id, id, score, r::int as rank from (select *, row_number() over (partition by query_id order by score desc, id desc) as r from x) where r <= 10""",
)
def t6_hybrid(spark, sf_dir):
    """Sparse and dense lists of forty, put together for every benchmark item."""
    docs, items, vectors = (table(spark, sf_dir, x) for x in ("documents", "benchmark", "embeddings"))
    sparse = search.tfidf(docs, items, "doc_id", "text", "item_id", "text", k=40)
    held = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return search.hybrid(sparse, search.nearest(held, asked, "vec_id", "embedding", k=40, least=0.0))


@_r.query(
    "t11_paging",
    "select event_id, user_id, ts from events order by ts desc, event_id desc limit 20 offset 40",
)
def t11_paging(spark, sf_dir):
    """The third page of twenty, newest first."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).offset(40).limit(20)


@_r.query(
    "o3_token_sets",
    """
with a as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from benchmark),
d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents)
select item_id, doc_id, len(list_intersect(a.t, d.t))::int as shared, round(len(list_intersect(a.t, d.t)) / len(a.t)::double, 6) as recall from a join d on a.item_id = d.doc_id""",
)
def o3_token_sets(spark, sf_dir):
    """Shared tokens and recall of each benchmark item and the document of its number."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.ascii_tokens(F.col("text"))).alias("a"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.ascii_tokens(F.col("text"))).alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return items.join(docs, F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", shared.alias("shared"), F.round(shared / F.size("a"), 6).alias("recall"))
