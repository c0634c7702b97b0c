"""The pipeline's stages keep the columns of documents, keep clean documents, and act on planted cases."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillon.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"passage{k}" for k in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    clean = base.where("n_chars > 400").limit(40)
    body = lambda n: " ".join(f"w{n}x{k}" for k in range(80))
    planted = [
        (900001, body(1), "en", "p", 0), (900002, body(1), "en", "p", 0), (900003, body(1) + " tail", "en", "p", 0), (900004, f"{body(2)} {PASSAGE} {body(3)}", "en", "p", 0),
        (900005, f"{body(4)} {PASSAGE} {body(5)}", "en", "p", 0), (900006, None, None, None, None), (900007, "", "en", "p", 0), (900008, "12 34 " * 30, "en", "p", 0), (None, body(6), "en", "p", 0),
    ]
    return clean.unionByName(spark.createDataFrame(planted, base.schema)).withColumn("score", F.lit(0.5)).cache()


def after(spark, docs, names):
    for name, stage in corpus_pipeline.STAGES:
        if name in names:
            docs = stage(spark, docs, SF)
    return docs


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_filters(spark, docs):
    out = after(spark, docs, ["quality rules"])
    assert out.columns == docs.columns and not ids(out) & {900006, 900007, 900008} and {900001, 900004, None} <= ids(out)
    out = after(spark, docs, ["language id"])
    assert out.columns == docs.columns and not ids(out) & {900006, 900007, 900008}


def test_near_duplicates(spark, docs):
    out = after(spark, docs, ["n-gram jaccard"])
    assert out.columns == docs.columns and ids(out) & {900001, 900002, 900003} == {900001} and {None, 900006, 900007} <= ids(out)


def test_passages(spark, docs):
    out = after(spark, docs.where("doc_id in (900004, 900005)"), ["suffix dedup"])
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and "passage30" in rows[900004].text and "passage30" not in rows[900005].text
    assert rows[900005].n_chars == len(rows[900005].text) and "w5x70" in rows[900005].text


def test_rows_keep_their_own_texts(spark):
    """Repeated and null ids, clashing names, equal least ids: each row is a document of its own."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(2, a, 1), (2, f"x y z {PASSAGE}", 2), (1, f"{PASSAGE} first", 3), (None, f"n1 {PASSAGE}", 4), (None, b, 5), (2, a, 6), (9, None, 7), (9, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, changed__ int").withColumn("left__", F.lit("l")).withColumn("c0", F.lit(0)).withColumn("block", F.lit("b")).withColumn("n_chars", F.length("text").cast("long"))
    out = {r.changed__: r for r in corpus_pipeline.passage_stage(spark, docs, SF).collect()}
    assert set(out) == {r[2] for r in rows} and all(r.left__ == "l" and r.block == "b" for r in out.values())
    assert out[1].text == a and out[6].text == a and out[3].text == f"{PASSAGE} first" and out[5].text == b and out[7].text is None and out[8].text == ""
    # The space before the passage stands in row 2 as well, whose id is smaller than none.
    assert out[2].text == "x y z " and out[4].text == "n1" and out[2].n_chars == 6
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    got = sorted(r.changed__ for r in kept.collect())
    # Rows 1 and 6 are equal; all that hold the passage and little else are near copies, of which id 1 stays.
    assert kept.columns == docs.columns and (1 in got) != (6 in got) and {3, 5, 7, 8} <= set(got)
    whole = corpus_pipeline.near_duplicate_stage(spark, docs.where("changed__ = 2"), SF).collect()
    assert [r.text for r in whole] == [f"x y z {PASSAGE}"]


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
