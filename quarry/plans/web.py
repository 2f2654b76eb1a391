"""Queries over web pages and on redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.functions import text as T
from quarry.operators import html, redaction, search
from quarry.plans._registry import Registry
from quarry.session import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_SAFE = [n for n in P.active() if n not in ("email_address", "ipv4_public")]
_quote = lambda s: "'" + s.replace("'", "''") + "'"


@_r.query("f21_pattern_counts", "select doc_id, " + ", ".join(f"len(regexp_extract_all(text, {_quote(P.active()[n][1])}))::int as {n}" for n in _SAFE) + " from documents")
def f21_pattern_counts(spark, sf_dir):
    """Matches of each pattern that needs no look-around, in every document."""
    return redaction.scan_counts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", *_SAFE)


@_r.query("f23_scan")
def f23_scan(spark, sf_dir):
    """Counts of secrets and personal data of every document."""
    return redaction.scan_counts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "secret_count", "pii_count", "redaction_required", "email_address", "ipv4_public")


@_r.query("f22_extended_scan")
def f22_extended_scan(spark, sf_dir):
    """The same by the extended patterns."""
    return redaction.scan_counts(table(spark, sf_dir, "documents"), "doc_id", "text", extended=True).select("doc_id", "secret_count", "pii_count", "intl_phone", "swift_bic")


@_r.query("f25_redacted")
def f25_redacted(spark, sf_dir):
    """Every document with its findings replaced by their names."""
    return redaction.redacted(table(spark, sf_dir, "documents"), "doc_id", "text")


@_r.query("f26_findings")
def f26_findings(spark, sf_dir):
    """Findings that don't overlap, with their surroundings and whether these tell of a person."""
    docs = table(spark, sf_dir, "documents")
    found = redaction.findings(docs, "doc_id", "text", apart=True)
    return found.withColumn("personal", redaction.personal_context(F.col("context"), F.lit(50), F.length("context") - 50))


_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head[^>]*>.*?</head>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@_r.query("f37_visible_text", f"select page_id, {_VISIBLE} as text from pages")
def f37_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.visible_text(F.col("html")).alias("text"))


@_r.query("c18_plain_pages", f"with v as (select page_id, {_VISIBLE.replace('trim(', 'trim(', 1)} as t from pages) select page_id, u as text, sha256(u) as sha256, length(u)::int as char_count from (select page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') as u from v)")
def c18_plain_pages(spark, sf_dir):
    """Visible text with entities resolved, its hash and length."""
    rows = table(spark, sf_dir, "pages").select("page_id", T.unescape(html.visible_text(F.col("html"))).alias("text"))
    return rows.select("page_id", "text", F.sha2("text", 256).alias("sha256"), F.length("text").alias("char_count"))


_LINKS = r"""select page_id, list_transform(list_filter(list_transform(regexp_extract_all(html, '(?i)href=["'']([^"''#?]+)["'']', 1), lambda x: trim(x)), lambda x: starts_with(x, 'http://') or starts_with(x, 'https://') or starts_with(x, '/')),
  lambda x: case when starts_with(x, '/') then regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || x else x end) as links from pages"""


@_r.query("f38_links", _LINKS)
def f38_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.links(F.col("html"), F.col("url")).alias("links"))


@_r.query("f38_link_hosts", f"select regexp_extract(l, '://([^/]*)', 1) as host, count(*) as n, count(distinct page_id) as n_pages from (select page_id, unnest(links) as l from ({_LINKS})) group by 1")
def f38_link_hosts(spark, sf_dir):
    """Links and linking pages by host."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"), F.col("url"))).alias("l"))
    return rows.groupBy(F.regexp_extract("l", "://([^/]*)", 1).alias("host")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


_NAMED = """(?i)<meta\\s+(?:[^>]*?\\s+)?(?:property|name)=["'']([^"'']+)["''][^>]*content=["'']([^"'']*)["'']"""
_TURNED = """(?i)<meta\\s+(?:[^>]*?\\s+)?content=["'']([^"'']*)["''][^>]*(?:property|name)=["'']([^"'']+)["'']"""


@_r.query("f39_meta_tags", f"""
with t as (select page_id, html, list_concat(regexp_extract_all(html, '{_NAMED}', 1), regexp_extract_all(html, '{_TURNED}', 2)) as k, list_concat(regexp_extract_all(html, '{_NAMED}', 2), regexp_extract_all(html, '{_TURNED}', 1)) as v from pages)
select page_id, case when html is not null then '{{' || coalesce(array_to_string(list_transform(list_filter(range(1, len(k) + 1), lambda i: not list_contains(k[i + 1:], k[i])), lambda i: to_json(k[i])::varchar || ':' || to_json(v[i])::varchar), ','), '') || '}}' end as meta from t""")
def f39_meta_tags(spark, sf_dir):
    """The meta tags of all pages as JSON."""
    return table(spark, sf_dir, "pages").select("page_id", F.to_json(html.meta_tags(F.col("html"))).alias("meta"))


_MARKS = " ".join(f"when {' or '.join(f'contains(html, {_quote(s)})' for s in signs)} then '{name}'" for name, signs in html.FRAMEWORKS.items())


@_r.query("f40_client_rendered", f"""
with v as (select page_id, length({_VISIBLE})::int as text_length, coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda s: length(s))), 0) / length(html)::double as sr, case {_MARKS} end as primary_framework from pages),
s as (select *, round(least(1.0, (case when text_length < 1000 then 0.4 else 0 end) + (case when sr > 0.7 then 0.3 else 0 end) + (case when primary_framework is not null then 0.2 else 0 end) + (case when text_length < 200 then 0.1 else 0 end)), 2)::double as confidence from v)
select page_id, text_length, round(sr, 6) as script_ratio, primary_framework, confidence, confidence > 0.5 as is_csr from s""")
def f40_client_rendered(spark, sf_dir):
    return html.client_rendered(table(spark, sf_dir, "pages"), "page_id", "html")


@_r.query("f35_content_chunks")
def f35_content_chunks(spark, sf_dir):
    """Weighted chunks of every page's body."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<body[^>]*>(.*)</body>", 1).alias("html"))
    return html.content_chunks(pages, "page_id", "html")


@_r.query("f36_pruned_content")
def f36_pruned_content(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<body[^>]*>(.*)</body>", 1).alias("html"))
    return html.pruned_content(html.content_chunks(pages, "page_id", "html"), "page_id")


@_r.query("t9_bm25_chunks")
def t9_bm25_chunks(spark, sf_dir):
    """BM25 of paragraphs, each page being a corpus of its own."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<p>(.*?)</p>"), F.lit(1))).alias("chunk_index", "raw"))
    chunks = rows.select("page_id", "chunk_index", T.strip_tags(F.col("raw")).alias("text"))
    return search.bm25(chunks, "page_id", "chunk_index", "text", ["the", "of", "that"]).select("page_id", "chunk_index", F.round("score", 6).alias("score"))


@_r.query("f42_structured_fields")
def f42_structured_fields(spark, sf_dir):
    return html.structured_fields(table(spark, sf_dir, "pages"), "page_id", "html")


@_r.query("p13_boilerplate", f"select page_id, len(list_filter(regexp_extract_all(html, '(?i)(?:class|id)=[\"'']([^\"'']*)[\"'']', 1), lambda x: regexp_matches(x, '(?i){html.BOILERPLATE}')))::int as n_boilerplate from pages")
def p13_boilerplate(spark, sf_dir):
    """Class and id attributes that name boilerplate."""
    names = F.regexp_extract_all("html", F.lit("(?i)(?:class|id)=[\"']([^\"']*)[\"']"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.filter(names, lambda x: x.rlike(f"(?i){html.BOILERPLATE}"))).alias("n_boilerplate"))


@_r.query("c7_crawl", f"""
with k as (select page_id, regexp_replace(url, '[?#].*$', '') as url from pages),
u as materialized (select distinct url from k where url is not null),
e as materialized (select distinct k.url, unnest(l.links) as dest from k join ({_LINKS}) l using (page_id)
  union select k.url, t.url from k join k as t on t.page_id in (2 * k.page_id + 1, 2 * k.page_id + 2)),
d0 as materialized (select distinct url from k where page_id % 100 = 0 and url is not null),
d1 as materialized (select distinct dest as url from e join d0 using (url) where dest in (from u) and dest not in (from d0)),
d2 as (select distinct dest as url from e join d1 using (url) where dest in (from u) and dest not in (from d0) and dest not in (from d1))
select url, 0 as depth from d0 union all select url, 1 from d1 union all select url, 2 from d2""")
def c7_crawl(spark, sf_dir):
    """Levels of pages reached from every hundredth page. The links of the generated pages lead out of the table, so each
    page gets two more, to the pages of twice its number and one or two."""
    pages = table(spark, sf_dir, "pages").withColumn("plain", F.regexp_replace("url", r"[?#].*$", ""))
    to = pages.select(F.expr("(page_id - 1) div 2").alias("page_id"), F.concat(F.lit('<a href="'), "plain", F.lit('">')).alias("link")).where("page_id >= 0 and link is not null")
    more = to.groupBy("page_id").agg(F.array_join(F.collect_list("link"), "").alias("more"))
    linked = pages.join(more, "page_id", "left").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.coalesce("more", F.lit(""))))
    return html.crawl(linked, pages.where("page_id % 100 = 0").select(F.col("plain").alias("url")), "page_id", "url", "html")


@_r.query("f43_key_values", """
select c_custkey, 'name' as key, c_name as value from customer union all select c_custkey, 'account balance', c_acctbal::decimal(12, 2)::varchar from customer
union all select c_custkey, 'segment', c_mktsegment from customer union all select c_custkey, 'nation', c_nationkey || ' : ' || c_custkey from customer where c_custkey % 2 = 0""")
def f43_key_values(spark, sf_dir):
    """Fields of customers' records as text, among lines that are none and keys that repeat."""
    nation = F.when(F.col("c_custkey") % 2 == 0, F.format_string("Nation:\t%d : %d\n", "c_nationkey", "c_custkey")).otherwise("Nation:\n")
    text = F.concat(
        F.format_string("  Name: %s  \nno field here\nAccount Balance: %s\n", "c_name", F.col("c_acctbal").cast("decimal(12,2)").cast("string")), nation,
        F.format_string("Segment: %s\nNAME: another\n1st: no key\n", "c_mktsegment"),
    )
    return html.key_values(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")
