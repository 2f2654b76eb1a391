import datetime
import random

import pytest

from quarry.operators import sessions
from quarry.session import table

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def walked(rows, gap, strict):
    """Ids of the rows that a walk over each key's rows accepts; (id, key, seconds)."""
    taken, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        if k not in last or last[k] is None or (t - last[k] > gap if strict else t - last[k] >= gap):
            last[k] = t
            taken.add(i)
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_accepted_rows_are_those_of_a_walk(spark, seed, monkeypatch):
    monkeypatch.setattr(sessions, "RUN", 3)
    rng = random.Random(seed)
    spread = [60, 400, 5000][seed]
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(-spread, spread)) for i in range(250)] + [(300, "a", None), (301, "c", None), (302, "c", None), (303, "c", 5)]
    frame = spark.createDataFrame([(i, k, None if t is None else START + datetime.timedelta(seconds=t)) for i, k, t in rows], "id int, k string, ts timestamp")
    for gap, strict in ((7, False), (7, True), (100, False)):
        got = sessions.spaced(frame, "k", "id", "ts", gap, strict)
        assert got.columns == frame.columns
        assert {r.id for r in got.collect()} == walked(rows, gap, strict) and got.count() == len(walked(rows, gap, strict))


def test_windows_are_those_of_a_walk(spark, monkeypatch):
    monkeypatch.setattr(sessions, "RUN", 2)
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", None]), round(rng.random() * 300, 3), f"w{i:03}") for i in range(200)]
    frame = spark.createDataFrame([(k, t, t + 1, w) for k, t, w in rows] + [("a", None, None, "none")], "k string, s double, e double, w string")
    wanted, since = {}, {}
    for k, t, w in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in since or round((t - since[k][1]) * 1000) >= 5000:
            since[k] = (since[k][0] + 1 if k in since else 0, t)
        wanted.setdefault((k, since[k][0]), []).append(w)
    got = {(r.k, r.segment): r.text.split(" ") for r in sessions.fixed_windows(frame, "k", "s", "e", "w", 5.0).collect()}
    assert got == wanted


def test_no_task_needs_python_or_all_of_a_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("ts", "t")
    out = sessions.spaced(rows, "event_type", "event_id", "t", 3600)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "hashpartitioning(event_type" not in plan
