import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, sharding
from quarry.session import table
from tests.llm import helpers


def least_capacity(sizes, shards):
    """By trying capacities one after another that sums of neighbours have."""

    def fits(c):
        used, room = 1, c
        for x in sizes:
            if x > c:
                return False
            used, room = (used, room - x) if x <= room else (used + 1, c - x)
        return used <= shards

    sums = {sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}
    return min(c for c in sums if fits(c))


def groups(spark, sizes):
    return spark.createDataFrame([(k, n) for k, n in sizes.items()], "group long, size long")


def random_groups(seed):
    rng = random.Random(seed)
    n, most = rng.choice([3, 10, 60, 90]), rng.choice([2, 30, 1000])
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(n)] if seed % 2 else [rng.randrange(64) for _ in range(n)]
    return {k: rng.randrange(1, most) for k in keys}


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_least_and_cuts_keep_it(spark, seed):
    sizes, shards = random_groups(seed), 7
    made = sharding.plan(groups(spark, sizes), shards, first=3, more=5)
    held = defaultdict(int)
    for r in groups(spark, sizes).select("size", made.shard_of(F.col("group")).alias("shard")).collect():
        held[r.shard] += r["size"]
    rest = [sizes[k] for k in sorted(sizes) if k not in made.giants]
    left, open_ = sum(rest), shards - len(made.giants)
    wanted = least_capacity(rest, open_) if rest else 0
    assert max(v for k, v in held.items() if k >= len(made.giants)) <= wanted if rest else True
    assert made.capacity == max([wanted, *(sizes[k] for k in made.giants)])
    assert sum(held.values()) == made.total == sum(sizes.values()) and set(held) <= set(range(shards))
    assert not rest or open_ == 1 or max(rest) * open_ < left


def test_first_cells_do_not_matter(spark):
    sizes = random_groups(3)
    rows, dealt = groups(spark, sizes), []
    for first, more in ((1, 1), (16, 8), (60, 4)):
        made = sharding.plan(rows, 5, first=first, more=more)
        dealt.append((made.capacity, sorted(rows.select("group", made.shard_of(F.col("group"))).collect())))
    assert dealt[0] == dealt[1] == dealt[2]


def test_query_keeps_its_contract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").collect()
    rows = queries.QUERIES["op13_sharding"](spark, sf_dir).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs}
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    shards, of = defaultdict(list), defaultdict(set)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "bytes", None)
        shards[r.shard].append(r)
        of[texts[r.doc_id]].add(r.shard)
    assert set(shards) <= set(range(24)) and all(len(x) == 1 for x in of.values())
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in shards.values())
    keys = {t: k for t, k in table(spark, sf_dir, "documents").select("text", sharding.group_of(F.col("text"))).distinct().collect()}
    sizes = defaultdict(int)
    for r in docs:
        sizes[keys[r.text]] += len(texts[r.doc_id]) + 8
    _, made = sharding.slotted(table(spark, sf_dir, "documents"))
    assert not made.giants and max(sum(r["size"] for r in x) for x in shards.values()) <= made.capacity == least_capacity([sizes[k] for k in sorted(sizes)], 24)


def test_a_group_with_a_third_of_the_bytes_has_a_shard_of_its_own(spark):
    docs = spark.createDataFrame([(i, "same text " * 9 if i % 3 == 0 else f"text {i}" * 10) for i in range(900)], "doc_id long, text string")
    rows, made = sharding.slotted(docs, shards=5)
    sizes = {r.shard: (r.n, r.b) for r in rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    assert len(made.giants) == 1 and sizes[0][0] == 300
    assert max(b for s, (_, b) in sizes.items() if s) - min(b for s, (_, b) in sizes.items() if s) < 200


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 2)
    odd = [(i, t) for i, t, *_ in helpers.ODD] + [(None, None)] * 5
    docs = spark.createDataFrame([(*r, "mine") for r in odd], "doc_id long, text string, shard string")
    rows = sharding.slotted(docs, shards=4)[0].collect()
    assert sorted((r.id or -1, r["size"], r.text_crc32) for r in rows) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    out, made = sharding.sharded(docs, shards=4)
    assert out.columns == ["doc_id", "text", "shard", "shard_"] and {r.shard for r in out.select("shard").collect()} == {"mine"}
    assert sorted(r[0] for r in out.groupBy("shard_").count().select("count").collect()) == sorted(map(len, slots.values()))
    none, empty = sharding.slotted(docs.limit(0), shards=4)
    assert none.collect() == [] and (empty.capacity, empty.giants, empty.cuts) == (0, [], [])


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(200)], "doc_id long, text string")
    sharding.write(docs, str(tmp_path / "out"), shards=3, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").isEmpty()
    assert len(list((tmp_path / "out").glob("shard=0/*.parquet"))) <= 2
