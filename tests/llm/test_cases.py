"""Defined results for nulls, empty tables, repeated rows and clashing names in the operators' general forms."""

import pytest

from braidgraph.llm import common, media, pages, pii, quality


def test_clean_keeps_columns_and_rows(spark, odd_docs, no_docs):
    model = quality.trained(odd_docs)
    kept = quality.clean(odd_docs, model)
    verdicts = quality.quality(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == verdicts.where("keep").count()
    assert quality.clean(no_docs, model).columns == odd_docs.columns and quality.clean(no_docs, model).count() == 0


def test_described_replaces_its_own_names(spark, odd_docs, no_docs):
    files = media.media(odd_docs).selectExpr("*", "1 as width", "'x' as Payload", "2 as kept", "'e' as error")
    rows = media.described(files).collect()
    assert len(rows) == 13 and all(r["error"] is None and r["width"] % 8 == 0 and r["kept"] == 2 and isinstance(r["payload"], (bytes, bytearray)) for r in rows)
    assert media.described(media.media(no_docs)).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, None)], "doc_id long, media binary")
    assert all(r["error"] and r["width"] is None for r in media.described(nulls).collect())


def test_collisions_of_odd_tables(odd_docs, no_docs):
    assert pii.collisions(odd_docs).count() == 0 and pii.collisions(no_docs).count() == 0


def test_pages_of_odd_tables(spark):
    rows = [(None, None, None), (1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "::", ""), (3, "http://h", " \n "), (4, "http://h/x", "<p>" + "w " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "'x' as lines", "2 as n_shared", "3 as drops", "'t' as text")
    got = sorted((str(r["page_id"]), r["text"]) for r in pages.main_text(df).collect())
    assert got == [("1", "a"), ("1", "a"), ("2", ""), ("3", ""), ("4", ("w " * 50_000).strip()), ("None", "")]


def test_heavy_join_is_a_join(spark):
    rows = spark.createDataFrame([(i % 7 if i % 11 else None, i) for i in range(3000)] + [(99, 1)] * 1500, "k int, v int")
    of = spark.createDataFrame([(k, k * 10, 1500 if k == 99 else 400) for k in (0, 1, 2, 99)], "k int, w int, n int")
    from pyspark.sql import functions as F

    key = lambda df: sorted(map(str, df.collect()))
    for how in ("inner", "left"):
        assert key(common.heavy_join(rows, of, ["k"], F.col("n"), how)) == key(rows.join(of, "k", how).select("k", "v", "w", "n"))


def test_shared_folder_is_asked_for_on_a_cluster():
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster())
