"""Queries on governance, provenance, evaluation and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chunking, evaluate, governance, provenance
from quarry.plans._registry import Registry
from quarry.session import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

AS_OF = "timestamp'1995-06-17 00:00:00'"
_CLASS = "case o_orderpriority when '1-URGENT' then 'short' when '2-HIGH' then 'medium' when '3-MEDIUM' then 'long' when '4-NOT SPECIFIED' then 'policy_bound' else 'legal_hold' end"
_END = f"case {_CLASS} when 'short' then o_orderdate + interval 24 hour when 'medium' then o_orderdate + interval 2160 hour when 'long' then o_orderdate + interval 26280 hour when 'policy_bound' then o_orderdate + interval 8760 hour end"


def _records(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("retention_class", F.expr(_CLASS))


@_r.query("f48_retention", f"select o_orderkey, {_CLASS} as retention_class, {_END} as expires_at, coalesce({_END} <= timestamp '2024-06-17', false) as expired from orders")
def f48_retention(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("expires_at", governance.expires_at(F.col("o_orderdate").cast("timestamp"), F.col("retention_class")))
    return rows.select("o_orderkey", "retention_class", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), F.coalesce(F.col("expires_at") <= F.to_timestamp(F.lit("2024-06-17")), F.lit(False)).alias("expired"))


@_r.query("c13_retention_sweep", f"select {_CLASS} as retention_class, count(*) as kept from orders where not coalesce({_END} <= timestamp '2024-06-17', false) group by 1")
def c13_retention_sweep(spark, sf_dir):
    kept, _ = governance.collected(_records(spark, sf_dir), F.to_timestamp(F.lit("2024-06-17")), "o_orderdate", "retention_class")
    return kept.groupBy("retention_class").agg(F.count("*").alias("kept"))


@_r.query("j9_erasure", f"""
with r as (select c_nationkey as request_id, o_orderkey, {_CLASS} as k from customer join orders on o_custkey = c_custkey),
q as (select request_id, o_orderkey from r union all select distinct c_nationkey, -c_custkey from customer)
select q.request_id::bigint as request_id, case when r.k is null then 'not_found' when r.k = 'legal_hold' then 'legal_hold' else 'erased' end as outcome, count(*) as n, list_sort(list(q.o_orderkey)) as ids from q left join r on q.o_orderkey = r.o_orderkey group by 1, 2""")
def j9_erasure(spark, sf_dir):
    """Requests of each nation to erase its orders, some of which there are not."""
    people, orders = table(spark, sf_dir, "customer"), _records(spark, sf_dir)
    own = people.join(orders, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("request_id"), "o_orderkey")
    lost = people.select(F.col("c_nationkey").cast("long").alias("request_id"), (-F.col("c_custkey")).alias("o_orderkey")).distinct()
    return governance.erasure(own.union(lost), orders, "o_orderkey", "retention_class")


@_r.query("a18_compliance", "select count(*) as total, count(*) filter (where o_orderstatus = 'F') as fulfilled, count(*) filter (where o_orderstatus <> 'F' and o_orderdate + interval 30 day < timestamp '2024-06-17') as overdue, round(avg((o_orderstatus = 'F')::int), 4) as fulfilment_rate from orders")
def a18_compliance(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("done", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return governance.compliance(rows, F.to_timestamp(F.lit("2024-06-17")), "o_orderdate", "done")


@_r.query("j8_unregistered", "select l_orderkey, list_sort(list(distinct l_partkey)) as missing from lineitem where l_partkey not in (select p_partkey from part where p_size > 10) group by l_orderkey")
def j8_unregistered(spark, sf_dir):
    """Parts of orders that a registry of larger parts lacks."""
    return governance.unregistered(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_orderkey", "l_partkey")


@_r.query("p5_promotion", "select p_partkey, not (p_size = 1) and not (p_size > 45) and (case when p_size % 2 = 0 then 'approved' else 'pending' end) in ('approved', 'owner_asserted_and_reviewed') and (case when p_size % 5 = 0 then 'forbidden' else 'allowed' end) <> 'forbidden' as eligible from part")
def p5_promotion(spark, sf_dir):
    size = F.col("p_size")
    review, training = F.when(size % 2 == 0, "approved").otherwise("pending"), F.when(size % 5 == 0, "forbidden").otherwise("allowed")
    return table(spark, sf_dir, "part").select("p_partkey", governance.promotion_eligible(size == 1, size > 45, review, training).alias("eligible"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")
_RIGHTS_SQL = ", ".join(str((segment, name, *governance.RIGHTS[name])) for segment, name in zip(_SEGMENTS, governance.RIGHTS, strict=False))


@_r.query("p6_default_rights", f"select c_custkey, source_class, training_eligibility, redistribution_eligibility, retention_class, review_status from customer left join (values {_RIGHTS_SQL}) r(s, source_class, training_eligibility, redistribution_eligibility, retention_class, review_status) on c_mktsegment = s")
def p6_default_rights(spark, sf_dir):
    """Default rights by market segment standing for a class of source."""
    kinds = F.create_map(*[F.lit(x) for p in zip(_SEGMENTS, governance.RIGHTS, strict=False) for x in p])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.try_element_at(kinds, F.col("c_mktsegment")).alias("source_class"))
    return governance.with_default_rights(rows, "source_class")


@_r.query("p8_confidence", "with s as (select event_id, value / (select max(value) from events) as s from events) select event_id, case when s >= 0.9 then 'green' when s >= 0.75 then 'yellow' when s >= 0.5 then 'orange' else 'red' end as band, case when s >= 0.8 then 'HIGH' when s >= 0.5 then 'MEDIUM' else 'LOW' end as label from s")
def p8_confidence(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    most = F.broadcast(events.agg(F.max("value").alias("_m")))
    score = F.col("value") / F.col("_m")
    return events.crossJoin(most).select("event_id", governance.confidence_band(score).alias("band"), governance.confidence_label(score).alias("label"))


@_r.query("a17_band_counts", "with s as (select value / (select max(value) from events) as s from events), b as (select case when s >= 0.9 then 'green' when s >= 0.75 then 'yellow' when s >= 0.5 then 'orange' else 'red' end as band from s) select band, count(b.band) as n from (values ('green'), ('yellow'), ('orange'), ('red')) t(band) left join b using (band) group by band")
def a17_band_counts(spark, sf_dir):
    """Counts of all bands, empty ones too."""
    counted = p8_confidence(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"))
    bands = spark.createDataFrame([(b,) for b in ("green", "yellow", "orange", "red")], "band string")
    return bands.join(counted, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


@_r.query("p9_gates", """
with g as (select o_orderkey, o_orderkey % 5 <> 0 as pr, o_orderpriority as rights, (o_orderkey % 100) / 100.0 as replay, o_orderkey % 2 = 0 as det, o_orderkey % 3 <> 0 as red, o_orderstatus = 'F' as sig from orders),
f as (select o_orderkey, list_filter([case when not pr then 'provenance' end, case when not (o_orderkey % 7 = 0) then 'rights_status' end, case when not (replay >= 0.85) then 'replay_pass_rate' end, case when not det then 'deterministic' end, case when not red then 'redaction_complete' end, case when not sig then 'human_signoff' end], lambda x: x is not null) as failing from g)
select o_orderkey, failing, len(failing) = 0 as eligible from f""")
def p9_gates(spark, sf_dir):
    k = F.col("o_orderkey")
    failing = governance.gates(F.when(k % 5 != 0, 1.0).otherwise(0.5), F.when(k % 7 == 0, "APPROVED").otherwise("pending"), (k % 100) / 100, k % 2 == 0, k % 3 != 0, F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", failing.alias("failing")).withColumn("eligible", F.size("failing") == 0)


@_r.query("p7_write_violations", """
select p_partkey, list_filter([case when p_size % 4 = 0 then 'source_url' end, case when p_size % 3 = 0 then 'license' end, case when p_size % 2 = 0 and p_size % 5 = 0 then 'local_only' end, case when p_size % 7 = 0 then 'run_id' end, case when p_size % 6 = 0 then 'signal' end], lambda x: x is not null) as violations from part""")
def p7_write_violations(spark, sf_dir):
    s = F.col("p_size")
    pick = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    found = governance.write_violations(pick(s % 4 == 0, " ", "file://x"), pick(s % 3 == 0, "", "mit"), s % 2 == 0, pick(s % 5 == 0, "s3://bucket/x", "/tmp/x"), pick(s % 7 == 0, None, "run"), pick(s % 6 == 0, "Bad Signal", "acquire.completed"))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("violations"))


@_r.query("p11_illegal_moves", "with m as (select event_id, lag(event_type) over w as before, event_type as after from events window w as (partition by user_id order by event_id)) select event_id, before, after from m where (before, after) not in (('view', 'click'), ('click', 'purchase')) and before is not null")
def p11_illegal_moves(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    moves = table(spark, sf_dir, "events").select("event_id", before.alias("before"), F.col("event_type").alias("after")).where("before is not null")
    return governance.illegal_transitions(moves, {"view": ("click",), "click": ("purchase",)}).select("event_id", "before", "after")


@_r.query("p1_audit_query", "select event_id, event_type, user_id, ts from events where event_type in ('error', 'purchase') and user_id between 10 and 20 and ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20' order by event_id limit 50")
def p1_audit_query(spark, sf_dir):
    """A log query: kinds, operators and an inclusive range of time, in log order."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase") & F.col("user_id").between(10, 20) & F.col("ts").between("2024-01-05", "2024-01-20"))
    return rows.select("event_id", "event_type", "user_id", "ts").orderBy("event_id").limit(50)


@_r.query("p2_registry_list", "select p_partkey, p_name from part where p_brand = 'Brand#13' and p_size = 7")
def p2_registry_list(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_brand = 'Brand#13' and p_size = 7").select("p_partkey", "p_name")


@_r.query("j7_step_diff", """
with a as (select l_orderkey, l_linenumber, l_quantity as v from lineitem where l_returnflag <> 'N'), b as (select l_orderkey, l_linenumber, l_quantity + case when l_linenumber = 2 then 1 else 0 end as v from lineitem where l_linestatus = 'F')
select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) as l_linenumber, case when a.v is null then 'added' when b.v is null then 'removed' when a.v = b.v then 'unchanged' else 'modified' end as change, a.v as old_value, b.v as new_value
from a full join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber""")
def j7_step_diff(spark, sf_dir):
    """Two versions of orders' lines compared."""
    rows = table(spark, sf_dir, "lineitem")
    old = rows.where("l_returnflag <> 'N'")
    new = rows.where("l_linestatus = 'F'").withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_linenumber") == 2, 1).otherwise(0))
    out = governance.full_diff(old, new, ["l_orderkey", "l_linenumber"], "l_linenumber", F.col("l_quantity"))
    return out.drop("position")


@_r.query("o1_list_difference", "with l as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) filter (where l_linestatus = 'F') as a, list(l_partkey order by l_linenumber, l_partkey) filter (where l_returnflag = 'R') as b from lineitem group by l_orderkey) select l_orderkey, list_filter(coalesce(a, []), lambda x: not list_contains(coalesce(b, []), x)) as removed, list_sort(list_distinct(list_intersect(coalesce(a, []), coalesce(b, [])))) as shared from l")
def o1_list_difference(spark, sf_dir):
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("l_linenumber", "l_partkey")))), lambda x: x["l_partkey"])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(part(F.col("l_linestatus") == "F").alias("a"), part(F.col("l_returnflag") == "R").alias("b"))
    return rows.select("l_orderkey", governance.list_difference(F.col("a"), F.col("b")).alias("removed"), F.array_sort(F.array_intersect("a", "b")).alias("shared"))


@_r.query("c16_sync_state", "select coalesce(a.p_partkey, b.p_partkey) as p_partkey, case when b.h is null then 'pending' when a.h is null then 'remote_only' when a.h = b.h then 'synced' else 'conflict' end as state from (select p_partkey, md5(p_name) as h from part where p_size < 40) a full join (select p_partkey, md5(p_name || case when p_size % 10 = 0 then 'x' else '' end) as h from part where p_size > 5) b using (p_partkey)")
def c16_sync_state(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    local = part.where("p_size < 40").select("p_partkey", F.md5("p_name").alias("h"))
    remote = part.where("p_size > 5").select("p_partkey", F.md5(F.concat("p_name", F.when(F.col("p_size") % 10 == 0, "x").otherwise(""))).alias("h"))
    return governance.sync_state(local, remote, "p_partkey", "h")


@_r.query("f50_semver", "with v as (select p_partkey, (p_size // 10)::varchar || '.' || (p_size % 10)::varchar || '.' || (p_partkey % 3)::varchar as a, (p_size // 9)::varchar || '.' || (p_size % 9)::varchar || '.' || (p_partkey % 4)::varchar as b, p_size // 10 as a1, p_size % 10 as a2, p_partkey % 3 as a3, p_size // 9 as b1, p_size % 9 as b2, p_partkey % 4 as b3 from part) select p_partkey, a as old_version, b as new_version, case when b1 > a1 then 'major' when b2 > a2 then 'minor' when b3 > a3 then 'patch' else 'none' end as bump, a1::varchar || '.' || (a2 + 1)::varchar || '.0' as next_minor from v")
def f50_semver(spark, sf_dir):
    part = lambda *x: F.concat_ws(".", *[c.cast("string") for c in x])
    s, k = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", part(F.expr("p_size div 10"), s % 10, k % 3).alias("old_version"), part(F.expr("p_size div 9"), s % 9, k % 4).alias("new_version"))
    return rows.withColumns({"bump": governance.bump_kind(F.col("old_version"), F.col("new_version")), "next_minor": governance.bumped(F.col("old_version"), "minor")})


@_r.query("f59_license_lines", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as line_number from documents) select doc_id, line_number, line, regexp_matches(line, '(?i)\\b(affero|agpl)\\b') as quarantined from l where regexp_matches(line, '(?i)licen[cs]e|copyright|agpl')")
def f59_license_lines(spark, sf_dir):
    return governance.license_findings(table(spark, sf_dir, "documents"), "doc_id", "text")


@_r.query("a16_pack_quality", """
with p as (select o_orderkey, list(distinct l_returnflag || l_linestatus) as kinds, count(*) as n, avg(epoch(l_shipdate)) as mean from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey),
s as (select o_orderkey, 1.0 as completeness, least(1.0, len(kinds) / 5.0) as diversity, greatest(0.0, 1 - (1718582400 - mean) / 86400 / 365) as freshness from p)
select o_orderkey, round(completeness, 6)::double as completeness, round(diversity, 6)::double as diversity, round(freshness, 6)::double as freshness, round(completeness * 0.4 + diversity * 0.3 + freshness * 0.3, 6)::double as overall from s""")
def a16_pack_quality(spark, sf_dir):
    """Orders as packs of their lines."""
    item = F.struct(F.concat("l_returnflag", "l_linestatus").alias("content_type"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("double").alias("_us"))
    packs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(item).alias("_a"))
    packs = packs.withColumn("artifacts", F.transform("_a", lambda a: F.struct(a["content_type"].alias("content_type"), (a["_us"] / 1e6).alias("created_at"))))
    found = governance.pack_quality(packs, ["o_orderkey", "artifacts"], 1718582400.0)
    return found.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("completeness", "diversity", "freshness", "overall")])


# provenance

_ENTRY = "user_id::varchar || ':' || event_id::varchar || ':' || event_type"


def _payload():
    return F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("event_type"))


@_r.query("w7_hash_chain", f"""
with recursive e as (select user_id, event_id, {_ENTRY} as payload, row_number() over (partition by user_id order by event_id) as n from events),
c as (select user_id, event_id, n, payload, 'genesis' as prev_hash, sha256('genesis' || payload) as entry_hash from e where n = 1
  union all select e.user_id, e.event_id, e.n, e.payload, c.entry_hash, sha256(c.entry_hash || e.payload) from e join c on e.user_id = c.user_id and e.n = c.n + 1)
select user_id, event_id, payload, prev_hash, entry_hash from c""")
def w7_hash_chain(spark, sf_dir):
    """Each user's events as a hash chain."""
    return provenance.chained(table(spark, sf_dir, "events"), "user_id", ["event_id"], _payload())


@_r.query("w7_broken_links", f"""
with recursive e as (select user_id, event_id, {_ENTRY} as payload, row_number() over (partition by user_id order by event_id) as n from events),
c as (select user_id, event_id, n, payload, sha256('genesis' || payload) as entry_hash from e where n = 1
  union all select e.user_id, e.event_id, e.n, e.payload, sha256(c.entry_hash || e.payload) from e join c on e.user_id = c.user_id and e.n = c.n + 1),
b as (select *, case when event_id % 50 = 0 then reverse(entry_hash) else entry_hash end as h from c),
l as (select *, lag(h, 1, 'genesis') over (partition by user_id order by event_id) as p from b)
select user_id, event_id from l where sha256(p || payload) <> h""")
def w7_broken_links(spark, sf_dir):
    """Entries that no longer follow after every fiftieth hash was changed."""
    rows = w7_hash_chain(spark, sf_dir)
    bent = rows.withColumn("entry_hash", F.when(F.col("event_id") % 50 == 0, F.reverse("entry_hash")).otherwise(F.col("entry_hash")))
    return provenance.broken_links(bent, "user_id", ["event_id"], F.col("payload"), "entry_hash").select("user_id", "event_id")


@_r.query("w8_first_failure", f"""
with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) + case when event_id % 97 = 0 then 1 else 0 end as seq, {_ENTRY} as p, case when event_id % 89 = 0 then 'x' else sha256({_ENTRY}) end as h from events),
f as (select *, row_number() over (partition by user_id order by seq) as n from (select user_id, seq, p, h, event_id from e)),
b as (select user_id, seq, case when n <> seq then 'sequence gap' when sha256(p) <> h then 'content hash' end as reason from f)
select user_id, min(seq) as sequence from b where reason is not null group by user_id""")
def w8_first_failure(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("sequence", (place + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).cast("long"))
    rows = rows.withColumn("h", F.when(F.col("event_id") % 89 == 0, "x").otherwise(F.sha2(_payload(), 256)))
    return provenance.first_failure(rows, "user_id", "sequence", _payload(), "h").select("user_id", "sequence")


def _merkle_sql(keys: str, leaves: str, levels: int = 24) -> str:
    """Roots of leaves (keys, pos, h): levels are halved one after another, a lone node staying as it is."""
    out = f"with recursive l0 as materialized ({leaves}), s as (select {keys}, count(*) as n from l0 group by all)"
    for i in range(levels):
        out += f""", l{i + 1} as materialized (select {keys}, pos // 2 as pos, case when any_value(m) = 0 then min(h) else sha256(arg_min(h, pos) || arg_max(h, pos)) end as h
  from (select *, max(pos) over (partition by {keys}) as m from l{i}) group by {keys}, pos // 2)"""
    return out + f" select {keys}, n, h as root from l{levels} join s using ({keys})"


@_r.query("a24_merkle_roots", _merkle_sql("user_id", f"select user_id, row_number() over (partition by user_id order by event_id) - 1 as pos, sha256(sha256({_ENTRY})) as h from events"))
def a24_merkle_roots(spark, sf_dir):
    """The Merkle root of each user's events."""
    rows = table(spark, sf_dir, "events").withColumn("content_hash", F.sha2(_payload(), 256))
    return provenance.merkle_roots(rows, "user_id", ["event_id"], "content_hash")


@_r.query("c20_sealed_batches", _merkle_sql("user_id, seal", f"select user_id, p // 16 as seal, p % 16 as pos, sha256(sha256(e)) as h from (select user_id, {_ENTRY} as e, row_number() over (partition by user_id order by event_id) - 1 as p from events)", 5))
def c20_sealed_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("content_hash", F.sha2(_payload(), 256))
    return provenance.sealed_batches(rows, "user_id", "event_id", "content_hash", 16)


@_r.query("a20_provenance_score", "select user_id, round(count(distinct case when event_type in ('view', 'click') then event_type end) / 5.0, 4)::double as provenance_score from events group by user_id")
def a20_provenance_score(spark, sf_dir):
    names = {"view": "acquire.completed", "click": "eval.completed"}
    signal = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    rows = table(spark, sf_dir, "events").withColumn("signal", F.try_element_at(signal, F.col("event_type")))
    return provenance.provenance_score(rows, "user_id", "signal").withColumn("provenance_score", F.round("provenance_score", 4))


@_r.query("a21_last_value", "select user_id, arg_max(value, event_id) as value from events where event_type = 'purchase' group by user_id")
def a21_last_value(spark, sf_dir):
    return provenance.last_value(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "purchase", "value")


@_r.query("k9_manifest", "select count(*) as total_files, sum(octet_length(encode(text))::bigint)::bigint as total_bytes, list_sort(list(distinct lang)) as categories from documents")
def k9_manifest(spark, sf_dir):
    return provenance.manifest(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").drop("manifest_hash")


@_r.query("f61_signals", "with s as (select event_id, event_type || '.' || case when event_id % 3 = 0 then 'completed' when event_id % 3 = 1 then 'started' else 'failed' end as s from events) select event_id, split_part(s, '.', 1) as plane, split_part(s, '.', 2) as action, split_part(s, '.', 2) in ('completed', 'failed') as terminal from s")
def f61_signals(spark, sf_dir):
    k = F.col("event_id") % 3
    signal = F.concat_ws(".", "event_type", F.when(k == 0, "completed").when(k == 1, "started").otherwise("failed"))
    return table(spark, sf_dir, "events").select("event_id", provenance.signal_parts(signal).alias("s")).select("event_id", "s.*")


# evaluation

_QA = "qa as (select conv_id, turn, text as answer, lag(text) over (partition by conv_id order by turn) as question, role from conversations)"


def _answers(spark, sf_dir):
    from pyspark.sql import Window

    asked = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("question", asked).where("role = 'assistant' and question is not null").withColumnRenamed("text", "answer")


@_r.query("a13_token_scores", f"""
with {_QA}, t as (select conv_id, turn, trim(answer) = trim(question) as eq, regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}_]+') as p, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+') as t from qa where role = 'assistant' and question is not null),
n as (select *, coalesce(list_sum(list_transform(list_intersect(p, t), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(t, lambda y: y = x))))), 0)::double as n from t),
s as (select conv_id, turn, case when len(p) = 0 and len(t) = 0 then 1.0 when len(p) = 0 or len(t) = 0 then 0.0 else n / len(p) end as precision, case when len(p) = 0 and len(t) = 0 then 1.0 when len(p) = 0 or len(t) = 0 then 0.0 else n / len(t) end as recall, eq from n)
select conv_id, turn, round(precision, 6)::double as precision, round(recall, 6)::double as recall, eq as exact_match, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6)::double as f1 from s""")
def a13_token_scores(spark, sf_dir):
    """Answers scored against the messages before them."""
    found = evaluate.token_scores(_answers(spark, sf_dir), F.col("answer"), F.col("question"), "conv_id", "turn")
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@_r.query("a14_rouge_l")
def a14_rouge_l(spark, sf_dir):
    return evaluate.rouge_l(_answers(spark, sf_dir), "answer", "question").select("conv_id", "turn", F.round("rouge_l", 6).alias("rouge_l"))


@_r.query("a15_macro_scores", f"select count(*) as n, round(avg(precision), 4) as precision, round(avg(recall), 4) as recall, round(avg(f1), 4) as f1 from ({ORACLES['a13_token_scores']})")
def a15_macro_scores(spark, sf_dir):
    found = a13_token_scores(spark, sf_dir)
    return found.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")])


_JUDGED = f"""
with {_QA}, w as (select conv_id, turn, answer, question, first_value(question) over (partition by conv_id order by turn) as context from qa where role = 'assistant' and question is not null),
t as (select *, regexp_extract_all(lower(answer), '[a-z0-9]+') as a, regexp_extract_all(lower(question), '[a-z0-9]+') as q, regexp_extract_all(lower(context), '[a-z0-9]+') as c from w),
d as (select *, list_distinct(a) as da, list_distinct(q) as dq from t),
n as (select *, list_sum(list_transform(list_intersect(da, dq), lambda x: len(list_filter(a, lambda y: y = x)) * len(list_filter(q, lambda y: y = x)))) as dot,
  list_sum(list_transform(da, lambda x: pow(len(list_filter(a, lambda y: y = x)), 2))) as na, list_sum(list_transform(dq, lambda x: pow(len(list_filter(q, lambda y: y = x)), 2))) as nq from d),
j as (select conv_id, turn, case when len(da) = 0 then 1.0 else len(list_filter(da, lambda x: list_contains(c, x))) / len(da) end::double as faithfulness,
  case when len(a) > 0 and len(q) > 0 then coalesce(dot, 0) / sqrt(na * nq) else 0.0 end::double as relevance,
  case when len(dq) = 0 then 1.0 else len(list_filter(dq, lambda x: list_contains(c, x))) / len(dq) end::double as context_recall,
  ((regexp_matches(answer, '(?i)the|de')::int + regexp_matches(answer, '(?i)\\.$')::int) / 2.0)::double as oracle, (trim(answer) = trim(question))::int::double as exact from n),
k as (select *, faithfulness * 0.25 + relevance * 0.25 + context_recall * 0.2 + oracle * 0.2 + exact * 0.1 as overall from j),
judged as (select conv_id, turn, {", ".join(f"round({c}, 6)::double as {c}" for c in ("faithfulness", "relevance", "context_recall", "oracle", "exact", "overall"))} from k)
"""


@_r.query("a12_judged_cases", _JUDGED + "select * from judged")
def a12_judged_cases(spark, sf_dir):
    """Answers judged against their question, the conversation's first message and simple rules."""
    from pyspark.sql import Window

    rows = _answers(spark, sf_dir).withColumn("context", F.first("question").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("rules", F.array(F.lit("the|de"), F.lit(r"\.$")))
    found = evaluate.judged(rows, "answer", "question", "context", "question", "rules", ["conv_id", "turn"])
    return found.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("faithfulness", "relevance", "context_recall", "oracle", "exact", "overall")])


@_r.query("a11_run_summary", _JUDGED + """, m as (select count(*) as n, round(avg((overall >= 0.5)::int), 4)::double as pass_rate, round(avg(faithfulness), 4)::double as faithfulness, round(avg(relevance), 4)::double as relevance, round(avg(context_recall), 4)::double as context_recall from judged)
select *, round(pass_rate * 0.3 + faithfulness * 0.3 + relevance * 0.2 + context_recall * 0.2, 4)::double as overall from m""")
def a11_run_summary(spark, sf_dir):
    """How all answers did."""
    return evaluate.run_summary(a12_judged_cases(spark, sf_dir), F.col("overall") >= 0.5, "faithfulness", "relevance", "context_recall")


@_r.query("j10_structured_scores", "with t as (select p_partkey, unnest(['brand', 'type']) as field, unnest([p_brand, p_type]) as v from part), p as (select p_partkey, unnest(['brand', 'type']) as field, unnest([lower(p_brand), case when p_size % 2 = 0 then p_type else 'none' end]) as v from part where p_size > 5) select t.p_partkey, t.field, case when lower(trim(t.v)) = lower(trim(p.v)) then 1.0 else 0.0 end::double as correct from t left join p using (p_partkey, field)")
def j10_structured_scores(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fields = lambda rows, a, b: rows.select("p_partkey", F.explode(F.create_map(F.lit("brand"), a, F.lit("type"), b)).alias("field", "value"))
    truth = fields(part, F.col("p_brand"), F.col("p_type"))
    said = fields(part.where("p_size > 5"), F.lower("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("none"))
    return evaluate.structured_scores(said, truth, ["p_partkey"], "field", "value")


@_r.query("a19_replay_summary", "select user_id, count(*) as n, round(avg((event_type <> 'error')::int), 6) as pass_rate, round(avg(case when event_type = 'purchase' then value / 100 else (event_type <> 'error')::int end), 6) as mean_score from events group by user_id")
def a19_replay_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumns({"passed": F.col("event_type") != "error", "score": F.when(F.col("event_type") == "purchase", F.col("value") / 100)})
    return evaluate.replay_summary(rows, "user_id", "passed", "score").withColumns({c: F.round(c, 6) for c in ("pass_rate", "mean_score")})


# chunking


@_r.query("f13_fixed_chunks", """
with n as (select doc_id, text, length(text) as n from documents where length(text) > 0),
c as (select doc_id, text, unnest(range(0, greatest(1, ceil((n - 512) / 448.0)::int + 1))) as i from n),
p as (select doc_id, i * 448 as start_char, substr(text, (i * 448 + 1)::bigint, 512) as text from c)
select doc_id, (row_number() over (partition by doc_id order by start_char) - 1)::int as chunk_index, text, start_char::int as start_char, (start_char + length(text))::int as end_char from p where length(trim(text)) >= 10""")
def f13_fixed_chunks(spark, sf_dir):
    return chunking.fixed(table(spark, sf_dir, "documents"), "doc_id", "text")


@_r.query("f14_sentence_chunks", """
with recursive s as materialized (select doc_id, unnest(x) as x, generate_subscripts(x, 1) as i from (select doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as x from documents where text is not null)),
c as (select doc_id, i, x as held, 0 as start, length(x) + 1 as place, cast(null as varchar) as text, cast(null as integer) as from_ from s where i = 1
  union all select doc_id, i, case when held = '' then x when length(longer) >= 512 then right(held, 64) || ' ' || x else longer end,
    case when held = '' or length(longer) >= 512 then place else start end, place + length(x) + 1,
    case when held <> '' and length(longer) >= 512 then held end, case when held <> '' and length(longer) >= 512 then start end
  from (select s.doc_id, s.i, s.x, held, start, place, trim(held || ' ' || s.x, ' ' || chr(9) || chr(10) || chr(13)) as longer from c join s on s.doc_id = c.doc_id and s.i = c.i + 1)),
o as (select doc_id, i - 1 as i, text, from_ as start_char from c where text is not null
  union all select doc_id, i, held, start from (select *, max(i) over (partition by doc_id) as m from c) where i = m and held <> ''),
k as (select * from o where length(text) >= 10)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_index, text, start_char::int as start_char, (start_char + length(text))::int as end_char from k""")
def f14_sentence_chunks(spark, sf_dir):
    return chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", "sentence", 10)


@_r.query("f15_topic_chunks")
def f15_topic_chunks(spark, sf_dir):
    return chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", "topic", 10)


@_r.query("f16_semantic_chunks")
def f16_semantic_chunks(spark, sf_dir):
    """Scored chunks, a line counting as a paragraph."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.chunked(docs, "doc_id", "text", "scored", 50)


@_r.query("f17_nested_chunks", """
with p as (select doc_id, i, substr(text, (i * 1024 + 1)::bigint, 1024) as t from (select doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 1024) / 1024.0)::int + 1))) as i from documents where length(text) > 0)),
q as (select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as parent_index, t from p where length(trim(t)) >= 1),
c as (select doc_id, parent_index, i, substr(t, (i * 256 + 1)::bigint, 256) as text from (select *, unnest(range(0, greatest(1, ceil((length(t) - 256) / 256.0)::int + 1))) as i from q))
select doc_id, parent_index, (row_number() over (partition by doc_id, parent_index order by i) - 1)::int as chunk_index, text from c where length(trim(text)) >= 1""")
def f17_nested_chunks(spark, sf_dir):
    return chunking.nested(table(spark, sf_dir, "documents"), "doc_id", "text")


@_r.query("w14_neighbour_chunks", """
with n as (select doc_id, text, length(text) as n from documents where length(text) > 0),
c as (select doc_id, text, unnest(range(0, greatest(1, ceil((n - 512) / 448.0)::int + 1))) as i from n),
p as (select doc_id, i * 448 as s, substr(text, (i * 448 + 1)::bigint, 512) as text from c),
k as (select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as chunk_index, text from p where length(trim(text)) >= 10)
select doc_id, chunk_index, right(lag(text) over w, 50) as before, substr(lead(text) over w, 1, 50) as after from k window w as (partition by doc_id order by chunk_index)""")
def w14_neighbour_chunks(spark, sf_dir):
    return chunking.with_neighbours(f13_fixed_chunks(spark, sf_dir), "doc_id").select("doc_id", "chunk_index", "before", "after")
