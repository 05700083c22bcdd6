"""Every operator and the pipeline over nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import os

import pytest

import corpus_pipeline
from genoframe.llm import queries

LONG = "the of and to in is " * 30 + " ".join(f"word{i}" for i in range(60_000))
DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, __text string, doc string, size int, spans string"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a"),
    (3, None, "en", "a"),
    (4, "", "fr", None),
    (5, "   \n\t ", None, "b"),
    (None, "le chat est dans la maison avec le chien et la souris", "fr", "b"),
    (7, "le chat est dans la maison avec le chien et la souris", None, None),
    (8, LONG, "en", "c"),
    (8, "another text with the same id", "en", "c"),
    (9, "$$$ %%% !!! 123 456", "en", "c"),
    (10, "çé   漢字かな 🎉 x", "xx", "c"),
    (11, LONG[: len(LONG) // 2], "en", "c"),
]


def write(spark, d, docs):
    extra = (None, 0.5, "t", "d", 3, "s")
    spark.createDataFrame([(*r[:4], len(r[1] or ""), *extra) for r in docs], DOC).coalesce(1).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1, int((r[0] or 0) % 2)) for r in docs] + ([(1, None, None), (None, 1, 1)] if docs else [])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    items = [(0, LONG[5000:5300]), (1, None), (2, ""), (None, "le chat est")] if docs else []
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    pages = [(1, "http://a.com/x?ref=1", "<p>"), (2, "https://www.a.com/x/", None), (3, None, "b"), (None, "http://b", "c"), (1, "http://a.com/x?ref=1", "<p>")] if docs else []
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edges"))
    write(spark, d, ROWS)
    return d


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nothing"))
    write(spark, d, [])
    return d


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_edges(spark, edges, name):
    rows = queries.queries()[name](spark, edges).collect()
    assert len(rows) == (5 if name.startswith("op6") else len(ROWS))
    if name.startswith("op3"):
        by = {(r.doc_id, r.n_bytes): r for r in rows}
        size = len(ROWS[0][1].encode())
        assert by[2, size].n_removed == size and by[3, 0].n_removed == 0
        assert by[11, len(ROWS[12][1].encode())].n_removed == len(ROWS[12][1].encode())
    if name.startswith("op5"):
        assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 9)} == {"und"}
    if name.startswith("op10"):
        assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3} and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
        assert [r.component_id for r in rows if r.doc_id is None] == [7]
    if name.startswith("op8"):
        assert {r.doc_id: r.n_items for r in rows if r.doc_id in (3, 11, 7)} == {3: 0, 11: 1, 7: 1}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_nothing(spark, nothing, name):
    assert queries.queries()[name](spark, nothing).collect() == []


def test_pipeline(spark, edges, nothing):
    assert corpus_pipeline.run(spark, nothing).collect() == []
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, edges)
        assert docs.columns == spark.read.parquet(f"{edges}/documents.parquet").columns, name
    rows = corpus_pipeline.run(spark, edges).collect()
    ids = [r.doc_id for r in rows]
    assert 3 not in ids and 4 not in ids and not (1 in ids and 2 in ids)


def test_nothing_is_left_behind_in_the_working_folder():
    assert not os.path.exists("spark-warehouse/links")
