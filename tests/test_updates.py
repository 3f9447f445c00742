"""Landed updates: offsets, refused lines, restarts."""

import json

import pytest
from pyspark.sql import functions as F

from dossier.sources import updates


def update(number, **more):
    return json.dumps({"update_id": number, "callback_query": {"id": f"c{number}", "data": f"full:{number}", "message": {"chat": {"id": 7}}} | more})


@pytest.mark.parametrize(("line", "error"), [("{", "not JSON"), ("[1]", "not an object"), ("{}", "no update_id"), ('{"update_id": true}', "no update_id"), ('{"update_id": 1e400}', "no update_id"), ('{"update_id": 3, "callback_query": 5}', "callback_query is no object"), ('{"update_id": 3}', None)])
def test_lines(line, error):
    assert updates.parsed(line)[-1] == error


def test_odd_parts():
    assert updates.parsed('{"update_id": 1, "callback_query": {"id": 5, "data": [1], "message": {"chat": 3}}}') == (1, "5", None, None, None)
    assert updates.parsed('{"update_id": 1, "callback_query": {"message": "x"}}') == (1, None, None, None, None)


def test_restart_opens_new_files_only(spark, tmp_path):
    given, base = tmp_path / "in", str(tmp_path / "run")
    given.mkdir()
    (given / "_ignored").write_text("x")
    none = [t.count() for t in updates.received(spark, str(given), str(tmp_path / "none"))]
    assert none == [0, 0]
    (given / "0001.jsonl").write_text("\n".join([update(1), "broken", "", update(2), update(1)]))
    (given / "0002.jsonl").write_text(update(3) + "\n" + "broken\n" + json.dumps({"update_id": 4}))
    accepted, refused = updates.received(spark, str(given), base)
    assert sorted((r.update_id, r.data) for r in accepted.collect()) == [(1, "full:1"), (2, "full:2"), (3, "full:3"), (4, None)]
    assert sorted((r.file, r.line, r.error) for r in refused.collect()) == [("0001.jsonl", 2, "not JSON"), ("0002.jsonl", 2, "not JSON")]
    # old files are not opened again: they now hold something else, and one can't be read at all
    (given / "0001.jsonl").write_text(update(98))
    (given / "0002.jsonl").unlink()
    (given / "0002.jsonl").mkdir()
    (given / "0003.jsonl").write_text(update(2) + "\n" + update(5) + "\n{")
    accepted, refused = updates.received(spark, str(given), base)
    assert sorted(r.update_id for r in accepted.collect()) == [1, 2, 3, 4, 5]
    assert refused.count() == 3
    assert updates.received(spark, str(given), base)[0].count() == 5


def test_outcomes(spark):
    rows = [
        ("c", "7", "full:1", "sent", True, "answered"), (None, "7", "full:1", "sent", True, "ignored_no_id"), ("", "7", "full:1", "sent", True, "ignored_no_id"), ("c", "8", "full:1", "sent", True, "forbidden_chat"),
        ("c", None, "full:1", "sent", True, "forbidden_chat"), ("c", "7", None, "sent", True, "unknown_prefix"), ("c", "7", "half:1", "sent", True, "unknown_prefix"), ("c", "7", "full:x", "sent", True, "bad_callback_data"),
        ("c", "7", "full:1", "failed", True, "delivery_not_found"), ("c", "7", "full:1", None, None, "delivery_not_found"), ("c", "7", "full:1", "sent", False, "version_unavailable"), (None, None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "callback_id string, chat_id string, data string, status string, matches boolean, expected string").withColumn("error", F.lit(None).cast("string"))
    for r in table.withColumn("outcome", updates.callback_outcome(F.lit(7), F.col("status"), F.col("matches"))).collect():
        assert r.outcome == r.expected, r
