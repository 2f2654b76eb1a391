import datetime
import random

import pytest
from pyspark.sql import functions as F

from quarry.streaming import events as streams
from quarry.streaming import late, limits

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain(rows, limit):
    """{id: (allowed, wait, rate)} of (id, user, second, pushed), user by user."""
    out, held = {}, {}
    for i, user, t, pushed in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, rate, last, won = held.get(user, (limit.burst, limit.rate, None, 0))
        if last is None or t - last >= limit.expire:
            tokens, rate, won = limit.burst, limit.rate, 0
        else:
            tokens = min(limit.burst, tokens + (t - last) * rate)
        ok = tokens >= 1
        wait = 0 if ok else (1 - tokens) / rate
        if ok:
            tokens, won = tokens - 1, 0 if pushed else won + 1
            if pushed:
                rate = max(limit.slowest, rate / 2)
            elif won % limit.wins == 0:
                rate = min(limit.rate, rate * 1.1)
        held[user] = tokens, rate, t, won
        out[i] = ok, pytest.approx(wait), pytest.approx(rate)
    return out


def test_buckets_are_those_of_a_walk_and_state_goes(spark, tmp_path):
    rng, limit = random.Random(4), limits.Limit(rate=0.5, burst=3.0, slowest=0.1, wins=2, expire=200.0)
    rows = [(i, rng.choice("ab"), rng.randrange(900), rng.random() < 0.3) for i in range(240)] + [(900 + i, "c", 10 + i, None) for i in range(9)] + [(990, "d", 5000, False)]
    frame = spark.createDataFrame([(i, u, at(t), p, t // 300) for i, u, t, p in rows], "id int, user string, ts timestamp, pushed boolean, batch int")

    def run():
        stream = spark.readStream.schema("id int, user string, ts timestamp, pushed boolean").parquet(str(tmp_path / "in"))
        with limits.rocks(spark):
            streams.stored(limits.rate_limited(stream, "user", "ts", "id", "pushed", "10 seconds", limit), str(tmp_path / "out"), str(tmp_path / "state"))

    streams.in_batches(frame, "batch", str(tmp_path / "in"), run)
    got = {r.id: (r.allowed, r.wait, r.rate) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain([(i, u, t, bool(p)) for i, u, t, p in rows], limit)
    assert {a for a, *_ in got.values()} == {True, False}
    held = spark.read.format("statestore").option("stateVarName", "bucket").load(str(tmp_path / "state"))
    assert [r.k for r in held.select(F.col("key.owner").alias("k")).collect()] == ["d"]


def test_late_rows_are_kept_once(spark, tmp_path):
    run = late.split(str(tmp_path), "ts", F.col("ts"), 10)
    batches = [[(1, 100), (2, 50)], [(3, 90), (4, 89), (5, None)], [(6, 300)], [(7, 290), (8, 291)]]
    for epoch in (0, 1, 2, 3, 1):  # a batch that runs again
        rows = [(i, None if t is None else at(t)) for i, t in batches[epoch]]
        run(spark.createDataFrame(rows, "id int, ts timestamp"), epoch)
    got = {r.id: r.late for r in spark.read.schema("id int, ts timestamp, late boolean").parquet(str(tmp_path / "rows")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True, 8: False}


def test_stored_streams_go_on_where_they_stopped(spark, tmp_path):
    frame = spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, batch int")
    seen = []

    def run():
        stream = spark.readStream.schema("id int").parquet(str(tmp_path / "in"))
        seen.append(streams.stored(stream, str(tmp_path / "out"), str(tmp_path / "state")).count())
        whole = streams.stored(stream.groupBy().agg(F.count("*").alias("n")), str(tmp_path / "n"), str(tmp_path / "n-state"), "complete")
        assert whole.first().n == seen[-1]

    streams.in_batches(frame, "batch", str(tmp_path / "in"), run)
    assert seen == [10, 20, 30] and spark.read.parquet(str(tmp_path / "out")).distinct().count() == 30
