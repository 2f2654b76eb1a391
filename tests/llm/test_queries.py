import pytest

import corpus_pipeline
from quarry.llm import queries
from quarry.session import table
from tests.llm import helpers
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir).sql(queries.ORACLES[name]))


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_join_query_agrees_with_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op7_jaccard_join"](spark, sf_dir).collect()}
    assert got == helpers.classes(docs)


def test_pipeline(spark, sf_dir):
    docs, kept = table(spark, sf_dir, "documents"), []
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        kept.append(rows)
        assert docs.columns == columns or number == len(corpus_pipeline.STAGES) - 1
    before = [(r.doc_id, r.text) for r in kept[0]]
    classes = helpers.classes(before)
    assert sorted(r.doc_id for r in kept[1]) == sorted(i for i, _ in before if classes[i][1] == i)
    assert len(kept[3]) == len(kept[2]) == len(kept[4])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in kept[4])


def test_repeated_rows_stay_once(spark, sf_dir):
    docs = spark.createDataFrame(helpers.ODD, "doc_id long, text string, lang string, source string")
    got = sorted((r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()), key=lambda i: (i is not None, i))
    assert got == [None, 1, 2, 3, 4, 5, 6, 7, 8]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (7, text + " more"), (7, "quite another text of enough words to have shingles"), (None, text), (9, text), (9, text), (11, "some other words that stay as they are"), (11, "some other words that stay as they are")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted([rows[0], rows[2], rows[3], rows[6]], key=repr)
