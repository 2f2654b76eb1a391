import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate, graph, packs
from quarry.sources import connectors, readers, variants
from quarry.streaming import events as streams


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_leaves_are_those_of_a_walk(spark):
    deep = None
    for i in range(40):
        deep = {"d": [deep, i]}
    values = [{"a": {"b": [1, 2.5, {"c": None}]}, "e": {}, "l": [], "t": "x"}, [1, [2, ["3"]]], 7, "s", None, deep]
    got = variants.leaves(variants.parsed(frame(spark, *map(json.dumps, values), "{bad", None), "text"), "v", "id").collect()
    wanted = {(i, k, v) for i, x in enumerate(values) for k, v in readers.flattened(x).items()}
    assert {(r.id, r.path, r.value) for r in got} == wanted and len(got) == len(wanted)


def test_traces_and_archives(spark):
    trace = {"start_url": "http://h", "actions": [{"type": "click", "selector": "#a", "more": {"x": [1]}}, {"value": 5}, 3]}
    got = variants.trace_actions(frame(spark, json.dumps(trace), '{"actions": []}', '{"actions": {}}', "x"), "text", "id").collect()
    assert [(r.id, r.start_url, r.position, r.action_type, r.target_selector, r.value) for r in sorted(got, key=lambda r: r.position)] == [
        (0, "http://h", 0, "click", "#a", None), (0, "http://h", 1, "unknown", None, "5"), (0, "http://h", 2, "unknown", None, None),
    ]
    har = {"log": {"entries": [{"startedDateTime": "2024-01-02T03:04:05Z", "time": 1.5, "request": {"method": "GET", "url": "u"}, "response": {"status": 404, "content": {"size": 7, "mimeType": "m"}}}, {}]}}
    rows = variants.har_entries(frame(spark, json.dumps(har)), "text", "id").orderBy("position").collect()
    assert tuple(rows[0])[3:] == ("GET", "u", 404, "m", 7, 1.5) and str(rows[0].started) == "2024-01-02 03:04:05" and set(tuple(rows[1])[2:]) == {None}


def test_vendors_pages_become_records(spark):
    adf = {"content": [{"content": [{"type": "text", "text": "one"}, {"type": "emoji"}]}, {}, {"content": [{"type": "text", "text": "two"}]}]}
    jira = {"startAt": 0, "total": 3, "issues": [{"key": "K-1", "fields": {"summary": "s", "description": adf, "status": {"name": "Open"}}}, {"fields": {}}, {"key": "K-2", "fields": {"description": None}}]}
    got = variants.vendor_records(frame(spark, json.dumps(jira)), "jira").orderBy("record_id").collect()
    assert [(r.record_id, r.title, r.content, r.metadata) for r in got] == [("K-1", "s", "one two", {"status": "Open"}), ("K-2", None, "", {})]
    slack = {"messages": [{"ts": "1.2", "user": "u", "text": "hi"}], "response_metadata": {"next_cursor": ""}}
    assert [r.content for r in variants.vendor_records(frame(spark, json.dumps(slack)), "slack").collect()] == ["hi"]
    tree = {"tree": [{"sha": "a", "path": "src/x.py", "type": "blob", "size": 3}]}
    assert variants.vendor_records(frame(spark, json.dumps(tree)), "github_tree").first().metadata == {"type": "blob", "size": "3"}
    for vendor in variants.MAPPINGS:
        assert variants.vendor_records(frame(spark, "{}", "[]", "[1]", "x", None), vendor).collect() == []


@pytest.mark.parametrize("vendor, page, wanted", [
    ("jira", {"startAt": 0, "total": 3, "issues": [1, 2]}, "2"), ("jira", {"startAt": 2, "total": 3, "issues": [1]}, None), ("slack", {"response_metadata": {"next_cursor": "c"}}, "c"),
    ("slack", {"response_metadata": {"next_cursor": ""}}, None), ("notion", {"next_cursor": None}, None), ("airtable", {"offset": "o"}, "o"), ("gitlab_issues", [], None),
])
def test_next_cursors(spark, vendor, page, wanted):
    row = variants.parsed(frame(spark, json.dumps(page)), "text").select(variants.next_cursor(F.col("v"), vendor).alias("c")).first()
    assert row.c == wanted


def test_paged_streams_go_on_behind_what_they_read(spark, tmp_path):
    folder = str(tmp_path / "pages")

    def held(options):
        import os

        place = f"{options['folder']}/{options['share']}"
        return len(os.listdir(place)) if os.path.isdir(place) else 0

    def page(options, number):
        with open(f"{options['folder']}/{options['share']}/{number}") as f, open(f"{options['folder']}-fetched", "a") as log:
            log.write(f"{options['share']}.{number}\n")
            return [{"record_id": x, "metadata": {"page": number}} for x in f.read().split()]

    spark.dataSource.register(connectors.paged("numbered", page, held))
    given = [{"0": ["a b", "c"], "1": ["d"]}, {"1": ["e", ""], "2": ["f"]}, {}]
    for n, more in enumerate(given):
        for share, pages in more.items():
            (tmp_path / "pages" / share).mkdir(parents=True, exist_ok=True)
            for text in pages:
                (tmp_path / "pages" / share / str(len(list((tmp_path / "pages" / share).iterdir())))).write_text(text)
        stream = spark.readStream.format("numbered").option("folder", folder).option("shares", "3").load()
        got = streams.stored(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        assert sorted(r.record_id for r in got.collect()) == sorted(x for m in given[: n + 1] for ps in m.values() for p in ps for x in p.split())
    fetched = (tmp_path / "pages-fetched").read_text().split()
    assert sorted(fetched) == sorted(set(fetched)) == ["0.0", "0.1", "1.0", "1.1", "1.2", "2.0"]


def test_pages_of_a_share_are_dealt_to_tasks():
    reader = connectors.paged("dealt", None, None)({"shares": "2"}).streamReader(None)
    parts = [p.value for p in reader.partitions({"0": 7, "1": 3}, {"0": 1207, "1": 3})]
    assert [n for s, a, b in parts for n in range(a, b)] == list(range(7, 1207)) and max(b - a for _, a, b in parts) <= 500


def test_tables_of_a_database_are_read_in_parts_of_equal_size(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/db", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    keys = [*range(100), *range(100_000, 100_300), 5_000_000, None, None]
    rows = spark.createDataFrame([(k, f"n{i}") for i, k in enumerate(keys)], "k long, name string")
    rows.coalesce(1).write.option("createTableColumnTypes", "name VARCHAR(20)").jdbc(f"{url};create=true", "t", properties=options)
    held = readers.jdbc_partitioned(spark, url, "t", "k", 4, bins=40_000, **options)
    sizes = [len(x) for x in held.rdd.glom().collect()]
    assert len(sizes) == 4 and sum(sizes) == len(keys) and max(sizes) <= 2 * len(keys) / 4
    assert sorted(map(repr, held.collect())) == sorted(map(repr, rows.collect()))
    some = held.where("name > 'n35' and k > 100010").select("name")
    assert "PushedFilters: [IsNotNull(name), IsNotNull(k), GreaterThan(name,n35), GreaterThan(k,100010)]" in some._jdf.queryExecution().toString().replace("*", "")
    rows.limit(0).write.jdbc(url, "bare", properties=options)
    assert readers.jdbc_partitioned(spark, url, "bare", "k", 4, **options).collect() == []


@pytest.mark.parametrize("bins, parts, wanted", [([(0, 5)], 3, [(None, None)]), ([(0, 1), (1, 1), (2, 1)], 3, [(None, 10), (10, 20), (20, None)]), ([(0, 100), (7, 1)], 2, [(None, 70), (70, None)])])
def test_ranges_of_a_key(bins, parts, wanted):
    assert readers.key_ranges(bins, 0, 10, parts) == wanted


def test_what_texts_say(spark):
    rows = frame(spark, "Spark IS fast. a-b has_c uses  x9 contains y", None, "is has", "the is an is bb")
    got = [(r.id, r.position, r.subject, r.predicate, r.object, r.confidence) for r in graph.said(rows, "text", "id").collect()]
    assert got == [(0, 0, "spark", "is", "fast", 0.85), (0, 1, "has_c", "uses", "x9", 0.85), (3, 0, "the", "is", "an", 0.85)]


def test_steps_come_back_from_their_text(spark):
    steps = [("click", "#a", None), ("type", "#b c", "it's 'x' into it"), ("navigate", None, "http://h\n?x"), ("scroll", None, None), ("type", None, "v"), (None, None, None)]
    rows = spark.createDataFrame(steps, "k string, s string, v string")
    got = [tuple(r.p) for r in rows.select(packs.parsed_step(packs.step_text(F.col("k"), F.col("s"), F.col("v"))).alias("p")).collect()]
    assert got == [*steps[:5], (None, None, None)]


def test_runs_end_at_their_first_failure(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("a", 3, True), ("a", 4, False), ("b", 1, True), ("c", 1, False)], "run string, step int, ok boolean")
    told = evaluate.step_statuses(rows, ["run"], "step", "ok")
    assert [(r.run, r.step, r.status) for r in told.orderBy("run", "step").collect()] == [("a", 1, "passed"), ("a", 2, "failed"), ("a", 3, "skipped"), ("a", 4, "skipped"), ("b", 1, "passed"), ("c", 1, "failed")]
    report = {r.run: tuple(r)[1:] for r in evaluate.step_report(told, ["run"], "step").collect()}
    assert report == {"a": (4, 1, 2, 2, False), "b": (1, 1, 0, None, True), "c": (1, 0, 0, 1, False)}


def test_tables_and_fields_in_markdown(spark):
    row = spark.createDataFrame([("a|b\n c", None, 3)], "x string, y string, z int")
    got = row.select(readers.markdown_line(F.col("x"), F.col("y"), F.col("z")).alias("l"), readers.key_value_lines({"x": F.col("z"), "y": F.col("y"), "w": F.col("z")}).alias("k")).first()
    assert got.l == "| a\\|b c |  | 3 |" and got.k == "**x**: 3\n**w**: 3"


def test_watched_folders_tell_of_each_file_once(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    seen = []
    for name, body in (("a.md", b"one"), ("deep/b.txt", "zwei é".encode()), ("c.exe", b"no"), ("d.md", b"\xff\xfe")):
        (tmp_path / "in" / name).write_bytes(body)
        got = streams.stored(readers.watched(spark, str(tmp_path / "in"), ("md", "txt")), str(tmp_path / "out"), str(tmp_path / "state"))
        seen.append(sorted((r.name, r.size, r.text, r.error) for r in got.collect()))
    assert seen[0] == [("a.md", 3, "one", None)] and seen[2] == seen[1]
    assert seen[3] == [("a.md", 3, "one", None), ("b.txt", 7, "zwei é", None), ("d.md", 2, None, "not UTF-8")]
