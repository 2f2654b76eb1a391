"""Queries on scalar functions and smaller operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, dedup, evaluate, governance, graph, packs, provenance, search
from quarry.operators import textstats as S
from quarry.plans._registry import Registry
from quarry.plans.similarity import SIGNED, simhash_sql
from quarry.session import checkpointed, table
from quarry.sources import readers, sinks

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


@_r.query("f20_metadata", r"""
select doc_id, len(regexp_extract_all(text, '[^\s]+'))::int as word_count, length(text)::int as char_count, len(string_split(text, chr(10)))::int as line_count, lang from documents""")
def f20_metadata(spark, sf_dir):
    """What enrichment adds to a text: counts, and its language."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(F.regexp_extract_all(t, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))).alias("word_count"), F.length(t).alias("char_count"), F.size(F.split(t, "\n")).alias("line_count"), "lang"
    )


@_r.query("f9_estimated_jaccard", SIGNED + "select x.doc_id, len(list_filter(range(1, 129), lambda i: x.signature[i] = y.signature[i])) / 128.0::double as similarity from g x join g y on y.doc_id = x.doc_id + 1")
def f9_estimated_jaccard(spark, sf_dir):
    """Estimated similarity of each document and the next by id."""
    signed = checkpointed(dedup.derived_signatures(table(spark, sf_dir, "documents"), "doc_id", "text"))  # read twice
    nxt = signed.select((F.col("doc_id") - 1).alias("doc_id"), F.col("signature").alias("other"))
    return signed.join(nxt, "doc_id").select("doc_id", dedup.estimated_jaccard(F.col("signature"), F.col("other")).alias("similarity"))


@_r.query("f11_hamming", "select event_id, bit_count(xor(event_id, user_id))::int as distance from events")
def f11_hamming(spark, sf_dir):
    zero = F.lit(0).cast("long")
    return table(spark, sf_dir, "events").select("event_id", dedup.hamming(zero, F.col("event_id"), zero, F.col("user_id")).alias("distance"))


@_r.query("f41_embedded_state", r"select page_id, nullif(substr(regexp_extract(html, '(?s)__INITIAL_STATE__\s*=\s*(\{.*?\})\s*;', 1), 1, 8192), '') as state from pages")
def f41_embedded_state(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", packs.embedded_state(F.col("html")).alias("state"))


@_r.query("f44_plain_titles", r"select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as title from pages")
def f44_plain_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@_r.query("f46_normalised_names", r"select c_custkey, lower(trim(regexp_replace('  ' || c_name || '   X ', '\s+', ' ', 'g'))) as name from customer")
def f46_normalised_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalised_name(F.concat(F.lit("  "), "c_name", F.lit("   X "))).alias("name"))


@_r.query("f47_vector_norms", "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm from embeddings")
def f47_vector_norms(spark, sf_dir):
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(square), 6).alias("norm"))


@_r.query("f55_canonical_hashes", r"""select event_id, sha256('{"event": "' || event_type || '", "id": ' || event_id || ', "user": ' || user_id || '}') as hash from events""")
def f55_canonical_hashes(spark, sf_dir):
    """Hashes of events as canonical JSON, whatever the order of their fields."""
    body = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_id").alias("id"), F.col("event_type").alias("event")))
    rows = provenance.with_canonical(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body", "line")
    return rows.select("event_id", F.sha2("line", 256).alias("hash"))


@_r.query("f62_page_blocks", "select conv_id, string_agg(case role when 'user' then '> ' || text when 'system' then '# ' || text else text end, chr(10) || chr(10) order by turn) as page from conversations where trim(text) <> '' group by conv_id")
def f62_page_blocks(spark, sf_dir):
    """Conversations as pages of blocks."""
    kind = F.when(F.col("role") == "user", "quote").when(F.col("role") == "system", "heading_1").otherwise("paragraph")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("kind"), "text"))).alias("b"))
    return rows.select("conv_id", readers.blocks_text(F.col("b")).alias("page"))


@_r.query("f3_flattened", "select event_id, json_extract_string(props, '$.k') as k from events")
def f3_flattened(spark, sf_dir):
    """Nested JSON of events as dotted keys."""
    rows = readers.with_flattened(table(spark, sf_dir, "events").select("event_id", "props"), "props")
    return rows.select("event_id", F.try_element_at("flat", F.lit("k")).alias("k"))


@_r.query("s4_uniform_fields", """
with c as (select c_custkey, to_json({'id': c_custkey, 'name': c_name, 'balance': c_acctbal, 'top': c_custkey % 2 = 0, 'mixed': case when c_custkey % 3 = 0 then to_json(c_custkey) else to_json(c_name) end}) as j from customer),
k as (select c_custkey, unnest(json_keys(j)) as field, j from c), v as (select field, json_type(j, '$.' || field) as t from k)
select field, case when count(distinct t) > 1 then 'any' else case min(t) when 'UBIGINT' then 'int' when 'BIGINT' then 'int' when 'DOUBLE' then 'float' when 'BOOLEAN' then 'bool' else 'str' end end as type, false as nullable from v group by field
union all select 'rare', 'str', true""")
def s4_uniform_fields(spark, sf_dir):
    """Fields of customers as JSON, inferred: one of two kinds, one that most lack."""
    key = F.col("c_custkey")
    mixed = F.when(key % 3 == 0, key.cast("string")).otherwise(F.concat(F.lit('"'), "c_name", F.lit('"')))
    text = F.to_json(F.struct(key.alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), (key % 2 == 0).alias("top"), F.when(key % 5 == 0, F.lit("x")).alias("rare")))
    whole = F.concat(F.expr("left(t, length(t) - 1)"), F.lit(',"mixed":'), "m", F.lit("}"))
    rows = table(spark, sf_dir, "customer").select(text.alias("t"), mixed.alias("m")).select(whole.alias("json"))
    return readers.inferred_fields(rows, "json")


@_r.query("p12_oracle_rules", "select conv_id, turn, round(((regexp_matches(text, '(?i)the')::int + regexp_matches(text, '(?i)\\.$')::int + contains(lower(text), '[de')::int) / 3.0)::double, 6) as oracle from conversations")
def p12_oracle_rules(spark, sf_dir):
    """The share of rules that each message keeps, one of them no regular expression."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array(F.lit("the"), F.lit(r"\.$"), F.lit("[de")).alias("rules"))
    return evaluate.with_oracle_share(rows, "text", "rules").select("conv_id", "turn", F.round("oracle", 6).alias("oracle"))


@_r.query("p14_goals", "select page_id, contains(url, '/en/') or contains(lower(html), 'der die') as met from pages")
def p14_goals(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", packs.goal_met(F.col("url"), F.col("html"), "/en/", "Der Die").alias("met"))


@_r.query(
    "c3_simhash_index",
    simhash_sql() + "select x.doc_id as a, y.doc_id as b, (bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)))::int as distance from (select distinct item_id from benchmark) i join s x on x.doc_id = i.item_id join s y on x.doc_id <> y.doc_id where bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 3",
)
def c3_simhash_index(spark, sf_dir):
    """All other documents within three bits of each benchmark item's number's document."""
    hashed = dedup.simhash(table(spark, sf_dir, "documents"), "doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"))
    return dedup.simhash_neighbours(hashed, asked, "doc_id")


@_r.query("c19_decision_log", "select event_id, coalesce(case when event_id % 10 = 0 then event_id - 1 end, lag(event_id) over (partition by user_id, event_type order by event_id)) as parent, sha256(props) as payload_hash from events")
def c19_decision_log(spark, sf_dir):
    """Events as decisions: the parent given, else the last of the same user and kind."""
    rows = table(spark, sf_dir, "events").withColumn("parent_id", F.when(F.col("event_id") % 10 == 0, F.col("event_id") - 1))
    return provenance.decision_log(rows, ["user_id", "event_type"], "event_id", F.col("props")).select("event_id", "parent", "payload_hash")


@_r.query("o4_triple_union", "select lower(n_name) as subject, 'is_in' as predicate, lower(r_name) as object, count(*) as n from nation join region on n_regionkey = r_regionkey group by all")
def o4_triple_union(spark, sf_dir):
    """Triples of two batches, equal ones (case ignored) once."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = rows.select(F.col("n_name").alias("subject"), F.lit("is_in").alias("predicate"), F.col("r_name").alias("object"), F.lit(0).alias("batch"))
    two = rows.select(F.lower("n_name").alias("subject"), F.lit("is_in").alias("predicate"), F.upper("r_name").alias("object"), F.lit(1).alias("batch"))
    first = graph.first_by_group(one.unionByName(two), ["batch"])
    return first.groupBy(F.lower("subject").alias("subject"), "predicate", F.lower("object").alias("object")).agg(F.count("*").alias("n"))


@_r.query("o7_edge_union", "select l_orderkey, list_sort(list(distinct l_partkey)) as parts from lineitem group by l_orderkey")
def o7_edge_union(spark, sf_dir):
    """Children of orders from two halves of their lines, put together."""
    half = lambda c, name: table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(c, F.col("l_partkey"))).alias(name))
    both = half(F.col("l_returnflag") == "R", "a").join(half(F.col("l_returnflag") != "R", "b"), "l_orderkey")
    return both.select("l_orderkey", F.array_sort(F.array_union("a", "b")).alias("parts"))


@_r.query("a25_first_seen", "select user_id, list(event_type order by f) as kinds from (select user_id, event_type, min(event_id) as f from events group by all) group by user_id")
def a25_first_seen(spark, sf_dir):
    """Kinds of each user's events in the order first seen."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]).alias("kinds"))


@_r.query("a26_redaction_rates", "select doc_id, round(least(1.0, list_sum(list_transform(regexp_extract_all(text, '[0-9]{4,}'), lambda x: length(x))) / length(text)::double), 6) as rate from documents")
def a26_redaction_rates(spark, sf_dir):
    """The share of each text that long numbers make up."""
    found = F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0))
    total = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x)))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(F.least(F.lit(1.0), total / F.length("text")), 6).alias("rate"))


@_r.query("k1_flat_records", "select conv_id, coalesce(roles, '') as roles, n from (select conv_id, to_json(list(role order by turn))::varchar as roles, count(*) as n from conversations group by conv_id)")
def k1_flat_records(spark, sf_dir):
    """Conversations flattened for a table: nested values as JSON text."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.count("*").alias("n"))
    return sinks.flat(rows.select("conv_id", F.transform("r", lambda x: x["role"]).alias("roles"), "n"))


@_r.query("k3_projected", "select event_id, user_id, event_type from events")
def k3_projected(spark, sf_dir):
    """The fixed columns of an export; the scan reads no others."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")


@_r.query("s19_trace_diff", """
with r as (select user_id // 2 as pair, user_id % 2 as side, event_type, row_number() over (partition by user_id order by event_id) as i from events),
a as (select * from r where side = 0), b as (select * from r where side = 1)
select coalesce(a.pair, b.pair) as pair, coalesce(a.i, b.i) as position, a.event_type as old_value, b.event_type as new_value,
  case when a.i is null then 'added' when b.i is null then 'removed' when a.event_type = b.event_type then 'unchanged' else 'modified' end as change from a full join b on a.pair = b.pair and a.i = b.i""")
def s19_trace_diff(spark, sf_dir):
    """The events of all users compared by position, each even one's with the next one's."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(by).cast("long")).withColumn("pair", F.expr("user_id div 2"))
    one = lambda side: rows.where(F.col("user_id") % 2 == side).select("pair", F.col("i").alias("p"), F.col("i").alias("at"), "event_type")
    out = governance.full_diff(one(0), one(1), ["pair", "p"], "at", F.col("event_type"))
    return out.select("pair", F.col("p").alias("position"), "old_value", "new_value", "change")


@_r.query("t3_approximate_knn")
def t3_approximate_knn(spark, sf_dir):
    """The ten nearest of every hundredth vector by an index of lists that holds every row."""
    vectors = table(spark, sf_dir, "embeddings")
    centres = search.coarse_lists(vectors, "vec_id", "embedding")
    index = search.indexed(vectors, "vec_id", "embedding", centres)
    return search.nearest_in_lists(index, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", centres, probes=12)


@_r.query("a10_idf_terms", "with t as (select distinct conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from conversations) select term, count(*) as df, round(ln(((select count(distinct conv_id) from conversations) + 1) / (count(*) + 1)::double) + 1, 9) as idf from t group by term")
def a10_idf_terms(spark, sf_dir):
    """Smooth idf over conversations."""
    rows = table(spark, sf_dir, "conversations")
    joined = rows.select("conv_id", F.explode(T.ascii_tokens(F.col("text"))).alias("term")).distinct()
    n = rows.agg(F.count_distinct("conv_id")).first()[0]
    return S.inverse_document_frequencies(joined, n).withColumn("idf", F.round("idf", 9))


@_r.query("f18_chunk_overlaps", """
with n as (select doc_id, text, length(text) as n from documents where length(text) > 0),
c as (select doc_id, text, n, unnest(range(0, greatest(1, ceil((n - 512) / 448.0)::int + 1))) as i from n), p as (select doc_id, i, substr(text, (i * 448 + 1)::bigint, 512) as t from c), k as (select * from p where length(trim(t)) >= 10),
l as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as chunk_index, t, lag(t) over (partition by doc_id order by i) as b from k)
select doc_id, chunk_index::int as chunk_index, (right(b, 64) = left(t, 64)) as overlaps from l where b is not null""")
def f18_chunk_overlaps(spark, sf_dir):
    """Whether a chunk begins with the end of the one before."""
    chunks = chunking.fixed(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = chunks.withColumn("b", F.lag("text").over(Window.partitionBy("doc_id").orderBy("chunk_index"))).where("b is not null")
    return rows.select("doc_id", "chunk_index", (F.expr("right(b, 64)") == F.substring("text", 1, 64)).alias("overlaps"))
