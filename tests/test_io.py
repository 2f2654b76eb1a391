"""Sources, sinks and streams."""

import gzip
import json
import sqlite3
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import provenance
from quarry.sources import connectors, readers, robots, sinks
from quarry.streaming import events as streams


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>n</t></si><si><t>pen</t></si></sst>')
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>7</v></c><c r="C2"><v>9</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {ns}><sheetData/></worksheet>")


def test_files_and_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.html").write_text("<html><head><title>x</title></head><p>one &amp; two</p></html>")
    (tmp_path / "c.csv").write_text("h,k\n1,a|b\n")
    workbook(tmp_path / "d.xlsx")
    (tmp_path / "e.epub").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "f.epub", "w") as z:
        z.writestr("o/p.opf", '<package><manifest><item id="2" href="b.xhtml"/><item id="1" href="a.xhtml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>')
        z.writestr("o/b.xhtml", "<p>second</p>")
        z.writestr("o/a.xhtml", "<p>first</p>")
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "plain" and got["b.html"].text == "one & two" and got["c.csv"].text.endswith("| 1 | a\\|b |")
    assert got["e.epub"].error == "BadZipFile" and got["f.epub"].text == "first\n\nsecond" and "| pen | 7 |" in got["d.xlsx"].text
    assert {r.kind for r in got.values()} == {"document", "spreadsheet"}
    sheet = readers.workbooks(spark, str(tmp_path)).collect()
    assert [(r.sheet, r.cells) for r in sheet] == [("S", {"name": "pen", "n": "7"})]
    assert readers.frames(spark, str(tmp_path), "*.txt").first().frame_index == 0


def test_cut_references_stay():
    page = "<p>a &amp; b&am</p><p>c&amp d &lt;e&gt; &#233;&#xe9; &ampx; &amp;lt; &nosuch;</p>"
    assert readers.plain_text(page.encode(), "1.html") == "a & b&am c&amp d <e> éé &ampx; &lt; &nosuch;"


def test_json_sources(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), schema="a int").collect()
    assert readers.json_lines(spark, str(tmp_path / "bad.jsonl"), strict=False, schema="a int").count() == 1
    assert readers.flattened({"a": {"b": [1, None]}, "c": "x"}) == {"a.b[0]": "1", "a.b[1]": "", "c": "x"}
    df = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":"t","b":null}',)], "j string")
    assert readers.uniform_keys(df, "j") == ["a", "b"] and readers.uniform_keys(df.union(spark.createDataFrame([('{"z":1}',)], "j string")), "j") is None
    assert {r.field: (r.type, r.nullable) for r in readers.inferred_fields(df, "j").collect()} == {"a": ("any", False), "b": ("str", True)}
    assert readers.with_flattened(df, "j").first().flat == {"a": "1", "b": "x"}
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    assert readers.csv_table(spark, str(tmp_path / "t.csv")).dtypes == [("a", "string"), ("b", "string")]


def test_mail(spark, tmp_path):
    raw = "From: a@x.org\nTo: b@y.org, c@z.org\nSubject: Hi\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nbody\n--B\nContent-Type: text/csv\nContent-Disposition: attachment; filename=t.csv\n\n1,2\n--B--\n"
    (tmp_path / "m.eml").write_text(raw)
    (tmp_path / "box.mbox").write_text(f"From x\n{raw}\nFrom y\nSubject: Two\n\nsecond\n")
    got = readers.mails(spark, str(tmp_path)).orderBy("path", "position").collect()
    assert [r.subject for r in got] == ["Hi", "Two", "Hi"] and got[2].text == "body" and got[2].recipients == ["b@y.org", "c@z.org"]
    assert [a.name for a in got[2].attachments] == ["t.csv"]


def test_feeds_and_sitemaps(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>A &amp; B</title><link>http://x/1</link><description>&lt;p&gt;hi&lt;/p&gt;</description></item></channel></rss>")
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="http://x/2"/><updated>2024</updated></entry></feed>')
    got = {r.link: (r.title, r.summary) for r in readers.feeds(spark, str(tmp_path)).collect()}
    assert got == {"http://x/1": ("A & B", "hi"), "http://x/2": ("T", "")}
    site = b"<urlset><url><loc>http://x/</loc><priority>bad</priority></url><url><loc>http://x/b</loc><lastmod>2024</lastmod><priority>0.9</priority></url></urlset>"
    assert readers.sitemap_entries(gzip.compress(site)) == [("url", "http://x/", None, None, 0.5), ("url", "http://x/b", "2024", None, 0.9)]
    assert readers.sitemap_entries(b"no xml") == []


def test_robots(spark):
    text = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/y$\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /\nSitemap: http://h/s.xml"
    rules = robots.rules(spark.createDataFrame([("h", text), ("gone", None)], "host string, content string"))
    urls = spark.createDataFrame([("http://h/x/y",), ("http://h/x/z",), ("http://h/",), ("http://gone/",), ("http://none/",)], "url string")
    verdict = lambda agent: {r.url: r.allowed for r in robots.judged(urls, rules, "url", agent).collect()}
    assert verdict("a") == {"http://h/x/y": True, "http://h/x/z": False, "http://h/": True, "http://gone/": False, "http://none/": False}
    assert verdict("other")["http://h/x/y"] is False
    assert robots.sitemaps_of(text) == ["http://h/s.xml"]


PAGES = {None: ([{"record_id": 1, "title": "a", "metadata": {"k": 2}}], "next"), "next": ([{"record_id": 2}], None)}


def _fetch(options, cursor):
    pages = {None: ([{"record_id": 1, "title": "a", "metadata": {"k": 2}}], "next"), "next": ([{"record_id": 2}], None)}
    return pages[cursor]


def test_connectors(spark):
    if "demo" not in connectors.available():
        connectors.register(connectors.Connector("demo", _fetch, ("DEMO_TOKEN",)))
    assert connectors.available({})["demo"] is False and connectors.available({"DEMO_TOKEN": "x"})["demo"] is True
    got = connectors.read(spark, "demo").orderBy("record_id").collect()
    assert [(r.record_id, r.title, r.source_type) for r in got] == [("1", "a", "demo"), ("2", None, "demo")] and got[0].metadata == {"k": "2"}
    assert connectors.read(spark, "demo", maxRecords="1").count() == 1
    with pytest.raises(KeyError):
        connectors.read(spark, "missing")
    both = connectors.union(connectors.read(spark, "demo").select("record_id"), spark.createDataFrame([("9", "t")], "record_id string, title string"))
    assert both.count() == 3


def test_exports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b", ["x"], None), (2, None, [], 1.5)], "id int, title string, tags array<string>, score double")
    for kind in ("jsonl", "parquet", "csv"):
        sinks.export(rows, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    got = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("id").collect()
    assert got[0].tags == '["x"]' and got[1].title is None
    with pytest.raises(ValueError, match="nothing"):
        sinks.export(rows.limit(0), str(tmp_path / "none"), "parquet")
    assert sinks.arrow_stream(rows, str(tmp_path / "f.arrow"), ["id"], 1) == 2
    with pa.OSFile(str(tmp_path / "f.arrow")) as f:
        assert pa.ipc.open_file(f).num_record_batches >= 1
    assert sinks.sqlite(rows, str(tmp_path / "d.db"), "t", ["title"]) == 2
    with sqlite3.connect(tmp_path / "d.db") as db:
        assert db.execute("select count(*) from t").fetchone() == (2,)
    assert rows.select(sinks.markdown_row(["id", "title"])).first()[0] == "| 1 | a\\|b |"
    assert rows.select(sinks.html_row(["title"])).first()[0] == "<tr><td>a|b</td></tr>"
    assert sinks.wire(rows, "sse").first().line.startswith("data: {")
    assert "- id: int" in sinks.dataset_card(rows, "n")


def test_store_cache_and_handoff(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, content string")
    store = new.limit(1).select(F.sha2(F.lit("b").cast("binary"), 256).alias("sha256"))
    assert [(r.n, r.path[:11]) for r in sinks.put(new, store, "content", "n").collect()] == [(1, "objects/ca/")]
    known = spark.createDataFrame([("a", 1)], "t string, v int").select(F.sha2("t", 256).alias("sha256"), "v")
    got = sinks.cached(new.withColumnRenamed("content", "t"), known, "t", lambda m: m.withColumn("v", F.lit(5)), "v")
    assert {r.n: r.v for r in got.collect()} == {1: 1, 2: 1, 3: 5}
    packs = spark.createDataFrame([("p", "promoted", "k"), ("q", "draft", "k"), ("r", "promoted", "z")], "id string, status string, kind string")
    subs = spark.createDataFrame([("b", ["k"]), ("a", ["k", "y"])], "agent string, pack_types array<string>")
    assert {r.id: r.agents for r in sinks.handoff(packs, subs, "status", "kind").collect()} == {"p": ["a", "b"], "r": []}
    with pytest.raises(ValueError, match="missing"):
        sinks.evidence_package({}, str(tmp_path / "e.zip"))
    sinks.evidence_package({n: b"x" for n in sinks.EVIDENCE}, str(tmp_path / "e.zip"))
    assert zipfile.ZipFile(tmp_path / "e.zip").namelist() == sorted(sinks.EVIDENCE)


def test_webhook_signs_and_retries(spark):
    sent, answers = [], [500, 200]
    hook = sinks.webhook("http://x", b"k", lambda u, b, h: sent.append((b, h)) or answers.pop(0))
    hook(spark.createDataFrame([(1,)], "a int"), 0)
    assert len(sent) == 2 and sent[0][1]["X-Signature-256"] == sinks.signature(sent[0][0], b"k") and json.loads(sent[0][0]) == {"a": 1}
    with pytest.raises(RuntimeError):
        sinks.webhook("http://x", b"k", lambda *a: 500)(spark.createDataFrame([(1,)], "a int"), 1)


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed"))
    rows = [(i, "u1", s) for i, s in enumerate([0, 1, 2, 3, 100, 101, 500])] + [(9, "u1", 500), (20, "u2", 50)]
    df = spark.createDataFrame(rows, "id long, user string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(path + "/in")
    return path + "/in"


def stream(spark, feed):
    return streams.replayed(spark, feed, "id long, user string, ts timestamp")


def test_stream_windows(spark, feed):
    streams.drained(streams.tumbling(stream(spark, feed), "ts", "60 seconds", "10 seconds", "user"), "tumbling", "complete")
    got = {(r.user, r.start.timestamp() % 100000): r.n for r in spark.table("tumbling").collect()}
    assert sum(got.values()) == 9
    streams.drained(streams.sessions(stream(spark, feed), "ts", "30 seconds", "10 seconds", "user"), "sess", "complete")
    assert sorted(r.n for r in spark.table("sess").collect()) == [1, 2, 2, 4]
    streams.drained(streams.sliding_alerts(stream(spark, feed), "ts", "60 seconds", "30 seconds", "10 seconds", 4, "user"), "alerts", "complete")
    assert spark.table("alerts").count() >= 1
    streams.drained(streams.counters(stream(spark, feed), "user"), "counts", "complete")
    assert {r.user: r.n for r in spark.table("counts").collect()} == {"u1": 8, "u2": 1}


def test_stream_dedup_and_cooldown(spark, feed):
    streams.drained(streams.deduplicated(stream(spark, feed), "ts", "10 minutes", "user"), "once")
    assert spark.table("once").count() == 2
    streams.drained(streams.cooled_down(stream(spark, feed), "ts", "10 seconds", "user", 2, 10, 60), "cool")
    assert [r.n for r in spark.table("cool").orderBy("fired_at").collect()] == [2, 2, 2]


def test_stream_seals_and_dead_letters(spark, feed, tmp_path):
    marked = stream(spark, feed).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    marked.writeStream.foreachBatch(streams.sealed(str(tmp_path / "seals"), "user", "id", "h")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    got = {r.user: r.root for r in spark.read.parquet(str(tmp_path / "seals")).collect()}
    ids = [0, 1, 2, 3, 4, 5, 6, 9]
    import hashlib

    assert got["u1"] == provenance.merkle_root([hashlib.sha256(str(i).encode()).hexdigest() for i in ids])

    def fails(batch, epoch):
        raise OSError("no")

    streams.with_dead_letters(fails, str(tmp_path / "dead"))(spark.range(2), 3)
    assert spark.read.parquet(str(tmp_path / "dead")).first().error == "OSError: no"


def test_tasks_write_a_file_for_each_row(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from quarry.plans import files

    monkeypatch.setattr(DataFrameWriter, "text", None)  # Spark's commit would move the files one by one
    rows = spark.range(900).selectExpr("concat(id % 3, '/', id) as file", "case when id > 0 then concat('é', id) end as value").repartition(1)
    path = files._written(rows, "md", f"file:{tmp_path}/out")
    assert sorted((r.path[-5:] == "/0.md", bytes(r.content)) for r in readers.files(spark, path, "*.md").collect()) == sorted((i == 0, (f"é{i}" if i else "").encode() + b"\n") for i in range(900))
    assert not [x for x in (tmp_path / "out").rglob(".*")]
