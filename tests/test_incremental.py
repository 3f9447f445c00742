"""Runs, keyed state and resumption."""

import random

from pyspark.sql import functions as F

from dossier.streaming import incremental

KIND = "user_id long, event_id long, event_type string"


def merge(rows):
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def test_runs(spark, tmp_path):
    """Rows are merged on reading; each is written once a level, and a batch that runs again counts once."""
    schema = spark.createDataFrame([], "key long, n long").schema
    runs = incremental.Runs(spark, str(tmp_path), schema, merge, fan=3)
    for n in range(1, 12):
        runs.add(n, spark.createDataFrame([(n % 4, 1), (100 + n, 1)], schema))
        if n in (2, 3, 9):
            runs.add(n, spark.createDataFrame([(n % 4, 1), (100 + n, 1)], schema))
    expected = {(k, len([n for n in range(1, 12) if n % 4 == k])) for k in range(4)} | {(100 + n, 1) for n in range(1, 12)}
    assert {tuple(r) for r in runs.rows().collect()} == expected
    assert [r[3] for r in runs.live()] == ["2-1-9", "10", "11"]
    assert {p.name for p in tmp_path.iterdir()} == {*map(str, range(1, 12)), "1-1-3", "1-4-6", "1-7-9", "2-1-9"}
    runs.vacuum()
    assert {p.name for p in tmp_path.iterdir()} == {"2-1-9", "10", "11"} and {tuple(r) for r in runs.rows().collect()} == expected


def test_work_follows_the_batch(spark, tmp_path, monkeypatch):
    """Ten batches of a few rows after a large one write few rows, and only keys with late rows are judged again."""
    given = f"{tmp_path}/in"
    rows = [(k, k, "x") for k in range(2000)]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(given)
    run = lambda: incremental.upsert_stream(incremental.file_stream(spark, given, spark.createDataFrame([], KIND).schema, files_a_batch=1), ["user_id"], ["event_type"], "event_id", ["event_type"], base=f"{tmp_path}/run")
    run()
    rng = random.Random(1)
    for n in range(3):
        for m in range(2):
            more = [(rng.randrange(2010), 3000 + 100 * n + 10 * m + i, rng.choice(["x", "y", " "])) for i in range(8)]
            if n == 2:
                more.append((5, -1, "z"))
            spark.createDataFrame(more, KIND).coalesce(1).write.mode("append").parquet(given)
            rows += more
        judged = []
        real = incremental.upsert.batch_status
        with monkeypatch.context() as patch:
            patch.setattr(incremental.upsert, "batch_status", lambda none, late, *a, judged=judged, real=real: judged.append(late.select("user_id").distinct().count()) or real(none, late, *a))
            snapshot, statuses = run()
            got = sorted((r.event_id, r.user_id, r.status) for r in statuses.collect())
        assert judged in ([], [1]) and (n < 2 or judged == [1])
    last, first, expected = {}, {}, []
    for user, i, said in sorted(rows, key=lambda r: r[1]):
        if said == " ":
            expected.append((i, user, "failed"))
            continue
        if (user, i) != (5, -1) or (5, -1) not in first.values():
            expected.append((i, user, "new" if user not in last else "existing" if last[user] == said else "updated"))
        last[user] = said
        first.setdefault(user, (user, i))
    assert {r.user_id: (r.event_type, r.first_seen_at) for r in snapshot.collect()} == {u: (last[u], first[u][1]) for u in last}
    assert [g for g in got if g[1] != 5] == sorted(e for e in expected if e[1] != 5)
    small = [spark.read.parquet(f"{tmp_path}/run/snapshot/{n}").count() for n in range(2, 8)]
    assert max(small) <= 9


def test_once_only_goes_on(spark, tmp_path):
    schema = spark.createDataFrame([], "key string, n long").schema
    got = []
    for n in range(3):
        spark.createDataFrame([("a", n), (None, n), (f"k{n}", n)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        got.append(incremental.once_only(incremental.file_stream(spark, f"{tmp_path}/in", schema), ["key"], base=f"{tmp_path}/once").count())
    assert got == [3, 4, 5]
    assert incremental.once_only(incremental.file_stream(spark, f"{tmp_path}/in", schema), ["key"], base=f"{tmp_path}/once").count() == 5
