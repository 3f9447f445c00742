"""Global places of captures over many key ranges."""

from dossier.llm import warc
from dossier.llm.scratch import fresh_path


def test_places_are_gapless_and_in_order(spark):
    path = fresh_path(spark, "warc")
    rows = [(i % 37 if i % 11 else None, f"http://h{i % 5}.org/{i % 3}", "z" * (i % 7)) for i in range(200)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    for rows_a_span, run_rows in ((9, 20), (10**6, 10**6)):
        got = sorted(warc.capture_histories(spark, path, rows_a_span=rows_a_span, run_rows=run_rows, block_rows=3).collect(), key=lambda r: r.history_place)
        assert [r.history_place for r in got] == list(range(200))
        order = [(r.url_key, r.stamp, r.page_id is not None, r.page_id or 0) for r in got]
        assert order == sorted(order) and [(r.span, r.place) for r in got] == sorted((r.span, r.place) for r in got)
    empty = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.capture_histories(spark, empty).columns[0] == "history_place"
