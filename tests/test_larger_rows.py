"""Queries against their SQL on rows that only larger tables have."""

import os

import pytest
from compare import TABLES, duck, duck_rows, spark_rows

from dossier import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def tables(tmp_path, **others):
    for name in TABLES:
        if name not in others:
            os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    for name, df in others.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def agrees(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == duck_rows(duck(folder), queries.oracle_sql()[name], columns)


def test_titles(spark, tmp_path):
    pages = ["<title>a &quot;b&quot; &lt;c&gt; &amp;amp;</title><title>late</title>", "<head><title> cut\n off&amp</title></head>", "<p>none</p>", None, "<script>'<title>no</title>'</script><title>&#65; &amp;lt; yes</title>"]
    agrees(spark, tables(tmp_path, pages=spark.createDataFrame([(i, f"https://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")), "page_titles")


def test_costs_of_long_calls(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    agrees(spark, tables(tmp_path, orders=orders.withColumn("o_custkey", orders["o_custkey"] + 27_150)), "run_costs")


def test_judging_is_dealt_to_many_tasks(spark):
    for name in ("deep_faults", "triage_faults", "golden_faults"):
        assert queries.queries()[name](spark, SF).rdd.getNumPartitions() >= 16


def test_found_fields_need_no_joins(spark):
    assert "Join" not in queries.queries()["found_fields"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pages_are_not_broadcast(spark):
    for name in ("typed_enrichments", "detail_enrichments", "section_announcements"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan if name == "section_announcements" else "rightHint=(strategy=merge)" in plan


def test_pieces_are_handed_on_in_bounded_batches(spark, monkeypatch):
    from dossier.functions import segments

    monkeypatch.setattr(segments, "CUT_TEXT", 10)
    docs = spark.createDataFrame([(1, "abcde\nfgh" * 5), (2, None), (3, "")], "doc_id long, text string")
    rows = segments.chunks(docs, size=7).orderBy("n").collect()
    assert "".join(r.piece for r in rows) == "abcde\nfgh" * 5 and [r.n for r in rows] == list(range(len(rows))) and {r.doc_id for r in rows} == {1}
