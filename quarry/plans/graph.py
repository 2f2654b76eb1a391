"""Queries over triples and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import textstats as S
from quarry.plans._registry import Registry
from quarry.plans.text import PAIRS_SQL, SHARE
from quarry.session import checkpointed, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@_r.query("f29_triples")
def f29_triples(spark, sf_dir):
    """Relations that the sentences of all documents name."""
    return G.triples(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "subject", "predicate", "object", "confidence")


_NAME = r"([A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z][A-Za-z0-9]*)*)"
_IS = rf"{_NAME}\s+(?:is\s+(?:a|an|the))\s+{_NAME}"


@_r.query("f29_is_a", rf"""
with s as (select doc_id, trim(unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\r\n|\n|\r'))) as s from documents),
m as (select doc_id, unnest(regexp_extract_all(s, '(?i){_IS}', 1)) as subject, unnest(regexp_extract_all(s, '(?i){_IS}', 2)) as object from s)
select doc_id, lower(trim(subject)) as subject, lower(trim(object)) as object from m where lower(trim(subject)) <> lower(trim(object)) group by all""")
def f29_is_a(spark, sf_dir):
    """The is-a relations alone, case folded."""
    found = G.triples(_docs(spark, sf_dir), "doc_id", "text").where("predicate = 'is_a'")
    return found.select("doc_id", F.lower("subject").alias("subject"), F.lower("object").alias("object"))


@_r.query("f32_grouped_triples")
def f32_grouped_triples(spark, sf_dir):
    """The first triple of each subject, group of predicates and object over all documents."""
    found = G.triples(_docs(spark, sf_dir), "doc_id", "text")
    return G.first_by_group(found, ["doc_id", "pos"]).select("doc_id", "subject", "predicate", "object")


@_r.query("f31_entities")
def f31_entities(spark, sf_dir):
    return G.entities(_docs(spark, sf_dir), "doc_id", "text")


@_r.query("f33_markdown_triples", """
with h as (select c_custkey, c_name, c_mktsegment, c_nationkey from customer),
t as (select c_custkey, unnest([
  {'line': 0, 's': c_name, 'p': 'is_section', 'o': 'document', 'c': 0.5}, {'line': 2, 's': 'Field', 'p': 'related_to', 'o': 'Value', 'c': 0.65},
  {'line': 4, 's': 'segment', 'p': 'related_to', 'o': c_mktsegment, 'c': 0.65}, {'line': 6, 's': 'Nation', 'p': 'defined_as', 'o': 'NATION_' || c_nationkey, 'c': 0.8},
  {'line': 6, 's': 'Nation', 'p': 'belongs_to_section', 'o': c_name, 'c': 0.6}, {'line': 9, 's': 'Customer', 'p': 'is_a', 'o': 'party', 'c': 0.8},
  {'line': 10, 's': 'Kind', 'p': 'defined_as', 'o': 'kind ' || c_custkey % 3, 'c': 0.75}]) as x from h)
select c_custkey, x.line::int as line, x.s as subject, x.p as predicate, x.o as object, x.c::double as confidence from t""")
def f33_markdown_triples(spark, sf_dir):
    """Triples of customers as Markdown: headings, table rows, definitions and bullets, some of them twice."""
    page = F.format_string(
        "# %s\n\n| Field | Value |\n|---|---|\n| segment | %s |\n\nNation: NATION_%d\nNation: NATION_%d\nBalance: 12.5\n- Customer is a party\n* Kind: kind %d\n",
        "c_name", "c_mktsegment", "c_nationkey", "c_nationkey", F.col("c_custkey") % 3,
    )
    return G.markdown_triples(table(spark, sf_dir, "customer").select("c_custkey", page.alias("text")), "c_custkey", "text")


@_r.query("c4_entity_resolution")
def c4_entity_resolution(spark, sf_dir):
    """Entities of all documents' triples with their mentions."""
    found = G.first_by_group(G.triples(_docs(spark, sf_dir), "doc_id", "text"), ["doc_id", "pos"])
    return G.resolve(found, ["doc_id", "pos"])[0]


@_r.query("a22_linked_entities")
def a22_linked_entities(spark, sf_dir):
    return G.linked(G.triples(_docs(spark, sf_dir), "doc_id", "text"), ["doc_id", "pos"]).select("entity", "n_triples")


def _places(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lit("is_in").alias("predicate"), F.col("r_name").alias("dst"))
    back = edges.select(F.col("dst").alias("src"), F.lit("holds").alias("predicate"), F.col("src").alias("dst"))
    return edges.union(back)


_EDGES = "e as (select n_name as src, 'is_in' as predicate, r_name as dst from nation join region on n_regionkey = r_regionkey union all select r_name, 'holds', n_name from nation join region on n_regionkey = r_regionkey)"


@_r.query("c5_neighbours", f"""
with recursive {_EDGES}, v as (select min(n_name) as node, 1 as level from nation union select e.dst, v.level + 1 from v join e on e.src = v.node where v.level < 3),
f as (select node, min(level) as level from v group by node)
select src, predicate, dst, level::int as level from f join e on e.src = f.node where level <= 2""")
def c5_neighbours(spark, sf_dir):
    """Edges within two steps from the first nation."""
    start = table(spark, sf_dir, "nation").agg(F.min("n_name").alias("node"))
    return G.neighbours(_places(spark, sf_dir), start, 2)


@_r.query("j6_relations_entities", f"with {_EDGES}, n as (select n_name as name, 'nation' as kind from nation union all select r_name, 'region' from region) select src, a.kind as src_kind, predicate, dst, b.kind as dst_kind from e join n a on a.name = src join n b on b.name = dst")
def j6_relations_entities(spark, sf_dir):
    """Relations with the kinds of both their ends."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).union(table(spark, sf_dir, "region").select("r_name", F.lit("region")))
    a, b = (nodes.select(F.col("name").alias(c), F.col("kind").alias(f"{c}_kind")) for c in ("src", "dst"))
    return _places(spark, sf_dir).join(a, "src").join(b, "dst").select("src", "src_kind", "predicate", "dst", "dst_kind")


@_r.query("k6_cypher", f"""with {_EDGES} select 'MERGE (n:Place {{id: ''' || n_name || '''}}) SET n.name = ''' || n_name || ''';' as line from nation
union all select 'MATCH (a {{id: ''' || src || '''}}), (b {{id: ''' || dst || '''}}) MERGE (a)-[:' || upper(predicate) || ']->(b);' from e""")
def k6_cypher(spark, sf_dir):
    """Cypher statements of nations and relations."""
    names = table(spark, sf_dir, "nation").select(G.cypher_node(F.col("n_name"), F.col("n_name"), F.lit("Place")).alias("line"))
    return names.union(_places(spark, sf_dir).select(G.cypher_edge(F.col("src"), F.col("predicate"), F.col("dst"))))


@_r.query("k7_dot", f"""
with {_EDGES}, n as (select n_name as term, count(*) as frequency, row_number() over (order by count(*) desc, n_name) <= 10 as top from nation group by n_name)
select 'node' as part, '  "' || term || '" [label="' || term || '"' || case when top then ', style=filled' else '' end || '];' as line from n
union all select 'edge', '  "' || src || '" -> "' || dst || '" [label="' || predicate || '"];' from (select distinct * from e)""")
def k7_dot(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").groupBy(F.col("n_name").alias("term")).agg(F.count("*").alias("frequency"))
    return G.dot_lines(nodes, _places(spark, sf_dir))


def _taxonomy(spark, sf_dir):
    """(term, frequency, parent) and the edges of the taxonomy of all documents."""
    pairs = checkpointed(S.pmi_pairs(_docs(spark, sf_dir), "doc_id", "text", min_share=SHARE))
    parents = S.taxonomy_parents(pairs).select(F.col("child").alias("term"), "parent")
    both = [F.struct(F.col(f"term_{x}").alias("term"), F.col(f"freq_{x}").alias("f")) for x in "ab"]
    terms = pairs.select(F.explode(F.array(*both)).alias("x")).select("x.*")
    nodes = terms.groupBy("term").agg(F.max("f").alias("frequency")).join(parents, "term", "left")
    return nodes, pairs.select(F.col("term_a").alias("src"), F.lit("co_occurs").alias("predicate"), F.col("term_b").alias("dst"))


_NODES = PAIRS_SQL + ", v as (select term, max(f) as frequency from (select term_a as term, fa as f from r union all select term_b, fb from r) group by term)"


@_r.query("c6_enriched_taxonomy", _NODES + """
select child as subject, 'is_a' as predicate, parent as object, 0.9::double as confidence from u
union all select distinct a.term, 'part_of', b.term, 0.7 from v a join v b on length(b.term) > length(a.term) and contains(b.term, a.term)
union all select term_a, 'related_to', term_b, 0.75 from r""")
def c6_enriched_taxonomy(spark, sf_dir):
    """Triples that the taxonomy of all documents implies."""
    return G.enriched(*_taxonomy(spark, sf_dir))


@_r.query("j14_contained_terms", r"""
with t as (select distinct unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]{2,}')) as term from documents),
g as (select distinct term as other, substr(term, i, k) as term from (select term, i, unnest(range(3, least(length(term) - i + 1, (select max(length(term)) from t)) + 1)) as k from (select term, unnest(range(1, length(term) - 1)) as i from t)))
select term, other from g where length(other) > length(term) and term in (from t)""")
def j14_contained_terms(spark, sf_dir):
    """Terms of all documents inside longer ones."""
    terms = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z0-9_\-]{2,}"), F.lit(0))).alias("term"))
    return G.contained_terms(terms)


@_r.query("k8_jsonld", _NODES + """
select term, '{"@type":"DefinedTerm","name":"' || term || '","frequency":' || frequency || case when parent is null then '' else ',"broader":"' || parent || '"' end || '}' as jsonld from v left join u on u.child = v.term""")
def k8_jsonld(spark, sf_dir):
    """Terms of the documents' taxonomy as JSON."""
    nodes, _ = _taxonomy(spark, sf_dir)
    return nodes.select("term", G.term_jsonld(F.col("term"), F.col("frequency"), F.col("parent")).alias("jsonld"))


@_r.query("j11_merged_taxonomies", """
with a as (select r_name as term, count(*) as frequency, null::varchar as parent, list_sort(list(n_name)) as children from nation join region on n_regionkey = r_regionkey where n_nationkey < 15 group by r_name),
b as (select r_name as term, count(*) as frequency, 'WORLD' as parent, list_sort(list(n_name)) as children from nation join region on n_regionkey = r_regionkey where n_nationkey >= 10 group by r_name)
select coalesce(a.term, b.term) as term, coalesce(a.frequency, 0) + coalesce(b.frequency, 0) as frequency, coalesce(a.parent, b.parent) as parent, list_sort(list_distinct(list_concat(coalesce(a.children, []), coalesce(b.children, [])))) as children from a full join b using (term)""")
def j11_merged_taxonomies(spark, sf_dir):
    """Two overlapping halves of the nations by region, put together."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    half = lambda cond, parent: rows.where(cond).groupBy(F.col("r_name").alias("term")).agg(F.count("*").alias("frequency"), F.lit(parent).cast("string").alias("parent"), F.array_sort(F.collect_list("n_name")).alias("children"))
    return G.merged_taxonomies(half("n_nationkey < 15", None), half("n_nationkey >= 10", "WORLD"))


@_r.query("w12_trace_tree", """
with recursive s as (select event_id as span_id, case when event_id % 7 = 0 then null else event_id - event_id % 7 + (event_id % 7) // 2 end as parent_id from events),
t as (select span_id, span_id as root, 0 as depth, span_id::varchar as path from s where parent_id is null or parent_id not in (select span_id from s)
  union all select s.span_id, t.root, t.depth + 1, t.path || '/' || s.span_id from s join t on s.parent_id = t.span_id)
select span_id, root, depth::int as depth, path from t""")
def w12_trace_tree(spark, sf_dir):
    """Spans as trees of seven: root, depth and path."""
    e = F.col("event_id")
    spans = table(spark, sf_dir, "events").select(e.alias("span_id"), F.when(e % 7 != 0, e - e % 7 + F.floor((e % 7) / 2)).alias("parent_id"))
    return G.trace_tree(spans, "span_id", "parent_id")


@_r.query("p3_entity_search", "select c_name, c_custkey from customer where contains(lower(c_name), 'er#0000000') order by c_name, c_custkey limit 20")
def p3_entity_search(spark, sf_dir):
    """The first twenty customers whose name holds a text, whatever its case."""
    found = table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lower(F.lit("ER#0000000"))))
    return found.select("c_name", "c_custkey").orderBy("c_name", "c_custkey").limit(20)
