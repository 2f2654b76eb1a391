"""The registered queries of this folder: thin reports of what the operators return."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.llm import centroids, chat, collocations, decontaminate, divergence, jaccard_join, pfair, reputation, secrets, sharding, site_quality, suffix_tree, warc
from quarry.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql.strip()
        return function

    return keep


@query("op7_jaccard_join")
def op7_jaccard_join(spark, sf_dir):
    """Near-duplicate classes of all documents: 5-word shingles, Jaccard similarity of 0.75 or more."""
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op9_decontaminate")
def op9_decontaminate(spark, sf_dir):
    """Every document and benchmark item that it holds within an edit for five of the item's words."""
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query("op4_suffix_tree")
def op4_suffix_tree(spark, sf_dir):
    """log10 probabilities of all documents by the unigram base and by the suffix tree."""
    found = suffix_tree.scored(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("flag").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op8_warc",
    """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d having count(*) > 1)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when f.first is not null and f.first is distinct from p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first is distinct from p.page_id then f.first end as refers_to
from p left join f on p.d = f.d and p.n >= 100
""",
)
def op8_warc(spark, sf_dir):
    """All pages written as dictionary-compressed WARC archives and read back."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def quality_labels(spark, sf_dir):
    """(id, good): the labelled quality of documents, one row for each id."""
    labels = table(spark, sf_dir, "labels")
    return labels.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("good"))


@query("op1_pfair_mix")
def op1_pfair_mix(spark, sf_dir):
    """All documents mixed by source; a source's target is the square root of its number of rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.mixed(docs)


@query("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    """Every candidate secret of all documents with the forest's vote; values as digests."""
    trees = secrets.train(secrets.labelled_findings(spark))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.with_findings(docs, trees).select("doc_id", F.explode("findings").alias("f"))
    return found.select(
        "doc_id", F.col("f.start").alias("start"), F.length("f.value").alias("length"), F.col("f.times").alias("times"),
        F.sha2("f.value", 256).alias("digest"), F.col("f.assigned").alias("assigned"), F.col("f.score").alias("score"), F.col("f.is_secret").alias("is_secret"),
    )


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query(
    "op3_url_reputation",
    """
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
l as (select doc_id, min(quality) as q from labels group by doc_id),
o as (select u.*, 1 - l.q as bad,
    case when regexp_matches(host, '(^|[.])(co[.]uk|org[.]uk|ac[.]uk|gov[.]uk|com[.]au|net[.]au|org[.]au|co[.]jp|co[.]nz|co[.]za|co[.]in|com[.]br|com[.]mx|com[.]cn|com[.]tr)$') then 2 else 1 end as k,
    string_split(host, '.') as parts
  from u left join l on l.doc_id = try_cast(regexp_extract(u.path, '^/[a-z]{2}/([0-9]+)', 1) as bigint)),
h as (select host, array_to_string(parts[greatest(1, len(parts) - k):], '.') as domain, array_to_string(parts[greatest(1, len(parts) - k + 1):], '.') as suffix,
    count(bad)::double as n, coalesce(sum(bad), 0)::double as b from o group by all),
d as (select domain, suffix, sum(n) as n, sum(b) as b from h group by all),
s as (select suffix, sum(n) as n, sum(b) as b from d group by all),
m as (
  select lev, r as rate, greatest(1.0, least(1000.0, case when sp > 0 then r * (1 - r) / sp - 1 else 1000.0 end)) as st from (
    select lev, r, coalesce(sq / nullif(n, 0) - r * r - r * (1 - r) * kk / nullif(n, 0), 0) as sp from (
      select lev, sum(n) as n, case when sum(n) > 0 then sum(b) / sum(n) else 0.0 end as r, sum((n > 0)::int) as kk, sum(case when n > 0 then b * b / n end) as sq
      from (select 'h' as lev, n, b from h union all select 'd', n, b from d union all select 's', n, b from s) group by lev))),
sp as (select suffix, (b + st * rate) / (n + st) as p from s, m where lev = 's'),
dp as (select d.domain, d.suffix, (b + st * sp.p) / (n + st) as p from d join sp using (suffix), m where lev = 'd'),
hp as (select h.host, h.n + st as size, (b + st * dp.p) / (n + st) as p from h join dp using (domain, suffix), m where lev = 'h'),
r as (select * from (values ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'), ('block', 'example.org', '/en/1', 'example.org/en/1'),
  ('allow', 'com', '/fr/', 'com/fr/'), ('block', 'com', '/de/', 'com/de/')) as t(action, rh, rp, rule))
select o.page_id, o.host, o.path, f.rule, coalesce(f.action, case when hp.p - 1.645 * sqrt(hp.p * (1 - hp.p) / (hp.size + 1)) > 0.25 then 'block' else 'allow' end) as verdict,
  round(hp.p, 6) as posterior, round(hp.p - 1.645 * sqrt(hp.p * (1 - hp.p) / (hp.size + 1)), 6) as bound
from o join hp on hp.host = o.host
left join lateral (select action, rule from r where (o.host = rh or ends_with(o.host, '.' || rh)) and starts_with(o.path, rp) order by length(rule) desc limit 1) f on true
""",
)
def op3_url_reputation(spark, sf_dir):
    """A verdict for every page's url; a page's outcome is the label of the document in its path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    numbered = pages.select(
        F.col("page_id").alias("id"), F.regexp_extract(reputation.path_of(F.col("url")), "^/[a-z]{2}/([0-9]+)", 1).try_cast("long").alias("doc_id")
    )
    labels = quality_labels(spark, sf_dir).select(F.col("id").alias("doc_id"), (1 - F.col("good")).alias("bad"))
    outcomes = numbered.join(labels, "doc_id").groupBy("id").agg(F.max("bad").alias("bad"))
    found = reputation.judged(pages, outcomes, URL_RULES)
    return found.withColumnRenamed("id", "page_id").withColumns({c: F.round(c, 6) for c in ("posterior", "bound")})


def _rules_sql() -> str:
    words = "[" + ", ".join(f"'{w}'" for w in divergence.WORDS) + "]"
    inside = [x.replace("\\x0B", "\\v").replace("'", "''") for x in divergence.CLASSES]
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '[{x}]+', '', 'g'))" for x in inside)
    n, m = len(divergence.CLASSES) + 1, len(divergence.WORDS) + 1
    total = lambda c, k: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, k + 1)) + "]"
    part = lambda x, y: f"(case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0 end)"

    def distance(c: str, size: str, ref: str, refsize: str, k: int) -> str:
        p, q = f"({c}[i] / {size}::double)", f"({ref}[i] / {refsize}::double)"
        return f"sqrt(greatest(0, list_sum(list_transform(range(1, {k + 1}), lambda i: {part(p, q)} + {part(q, p)})) / 2))"

    return f"""
with d as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
g as (select doc_id, i, array_to_string(w[i:i+4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
r as (select doc_id, count(distinct i + j) as n from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g), (select unnest(range(0, 5)) as j) where c > 1 group by doc_id),
c as (select doc_id, lang, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words, length(t) as n_chars, [{counts}] as k, list_transform(w, lambda x: lower(x)) as lw from d left join r using (doc_id)),
h as (select * exclude (k, lw), k[6]::bigint as n_symbols, list_append(k, n_chars - list_sum(k)) as cl,
    list_append(list_transform({words}, lambda v: len(list_filter(lw, lambda x: x = v))), n_words - len(list_filter(lw, lambda x: list_contains({words}, x)))) as co,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c),
f as (select lang, {total("cl", n)} as rc, {total("co", m)} as ro, sum(n_chars) as rn, sum(n_words) as rm from h where not base_failed group by lang),
b as (select *, ro[{m}] / rm::double as q from f),
j as (select h.*, sqrt({divergence.MOST_SHARE**2!r} * greatest(0, ({part("1.0", "q")} + {part("q", "1.0")} + 1 - q) / 2) + {divergence.CHANCE!r} / nullif(n_words, 0)) as lim, case when n_chars >= {divergence.LEAST_CHARS} and rc is not null then {distance("cl", "n_chars", "rc", "rn", n)} end as cd,
    case when n_words >= {divergence.LEAST_WORDS} and ro is not null then {distance("co", "n_words", "ro", "rm", m)} end as wd from h left join b as f on h.lang is not distinct from f.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (coalesce(cd, 0) > {divergence.MOST_CLASS} or coalesce(wd > lim, false)) as kept, round(cd, 6) as class_distance, round(wd, 6) as word_distance from j"""


@query("op5_quality_rules", _rules_sql())
def op5_quality_rules(spark, sf_dir):
    """Base counts and the divergence verdict of all documents."""
    found = divergence.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    """The posterior quality of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = site_quality.with_quality(docs, quality_labels(spark, sf_dir))
    return found.select("doc_id", "evidence", "site_odds", "quality", (F.col("quality") >= site_quality.LEAST_GOOD).alias("kept"))


@query(
    "op10_tool_calls",
    """
select conv_id, turn, role, turn as "at", 0 as depth, cast(0 as bigint) as n_calls, cast(0 as bigint) as n_answered, cast(0 as bigint) as n_invalid,
  cast(0 as bigint) as n_needs_unmet, cast(null as bigint) as answered_by,
  to_json(struct_pack(content := coalesce(text, ''), conv_id := conv_id, role := role, tool_calls := []::int[], turn := turn))::varchar as line
from conversations
""",
)
def op10_tool_calls(spark, sf_dir):
    """All messages as canonical lines with their calls linked (the generated table has no calls)."""
    schemas = {"search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}}}}
    return chat.linked(table(spark, sf_dir, "conversations"), schemas)


@query("op13_sharding")
def op13_sharding(spark, sf_dir):
    """All documents in 24 shards of near equal bytes, equal texts together."""
    rows, _ = sharding.slotted(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _clusters_sql(width: int = centroids.WIDTH, clusters: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    apart = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select vec, arg_min(struct_pack(c := c.c, d := d), struct_pack(d := d, c := c.c)) as a from (select v.vec, c.c, {apart} as d from v, c{r} as c) as c group by vec)")
        if r < rounds:
            steps.append(
                f"m{r} as (select a.c as c, i, sum(v.x[i]) as s, count(*) as n from a{r} join v using (vec), (select unnest(range(1, {width + 1})) as i) group by all),\n"
                f"n{r} as (select c, list((s - ((s % n) + n) % n) // n order by i) as x from m{r} group by c),\n"
                f"c{r + 1} as materialized (select c, coalesce(n.x, o.x) as x from c{r} as o left join n{r} as n using (c))"
            )
    return f"""
with k as (select row_number() over () as vec, vec_id, embedding as e from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda y: isfinite(y))) = {width}),
v as materialized (select vec, vec_id, list_transform(e, lambda y: floor({centroids.SCALE} * y::double)::hugeint) as x from k),
c0 as materialized (select row_number() over (order by h, x) - 1 as c, x from (select sha256('{centroids.SEED}:' || vec_id) as h, x from v order by h, x limit {clusters})),
{", ".join(steps)},
t as (select a.c as c, sum(a.d) as t from a{rounds} group by 1),
s as (select c, sha256(array_to_string(x, ',')) as h from c{rounds})
select v.vec_id, a.c::int as cluster, a.d::bigint as distance, t.t::bigint as cluster_inertia, (select sum(t) from t)::bigint as inertia, s.h as centroid_sha256
from a{rounds} join v using (vec) join t on t.c = a.c join s on s.c = a.c"""


@query("op12_centroids", _clusters_sql())
def op12_centroids(spark, sf_dir):
    """40 clusters of all whole embeddings after five rounds."""
    rows, _ = centroids.clustered(table(spark, sf_dir, "embeddings"))
    return rows.withColumnRenamed("id", "vec_id")


@query(
    "op11_collocations",
    r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as materialized (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (select unnest(range(1, 6)) as k) where len(w) >= k) group by all having count(*) >= 100),
c as (select g.*, n.n, string_split(phrase, ' ') as parts, unnest(range(1, k)) as j from g join n using (lang) where k > 1),
s as (select c.lang, c.phrase, c.f as a, c.n, c.j, l.f as l, r.f as r, (1000::hugeint * c.f * c.n) // (l.f::hugeint * r.f) as score
  from c join g as l on l.lang = c.lang and l.phrase = array_to_string(c.parts[:c.j], ' ') join g as r on r.lang = c.lang and r.phrase = array_to_string(c.parts[c.j + 1:], ' ')),
e as (select lang, phrase, a, n, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(score := score, j := j)) as v from s group by lang, phrase, a, n),
b as (select lang, phrase, a, n, v.l as l, v.r as r, v.score as score from e),
o as (select * from b where not exists (select 1 from g where g.lang = b.lang and 100 * g.f >= 100 * b.a and g.phrase <> b.phrase and contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))),
t as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from o)
select lang, rank, phrase, a, l, r, n, score::bigint as score from t where rank <= 2000
""",
)
def op11_collocations(spark, sf_dir):
    """The best phrases of two to five words of each language of all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
