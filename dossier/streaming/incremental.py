"""Incremental runs whose batches cost in proportion to themselves.

Snapshots are merged when they are read: a batch writes the keys that it has as a run
of its own under its number, and FAN runs of one level become one of the next, so that
a row is written again as often as the logarithm of the number of batches.  Statuses
come from keyed state (RocksDB, with changelogs): each key's last row, against which its
next one is compared.  A row that comes after one with a larger position is set apart,
and only the keys with such rows are judged again, from the stored rows.  Rows that are
delivered once pass a stateful deduplication.

A batch that is run again after a failure writes the same runs and rows again, so that
every source row counts once.  Offsets and state are in the query's checkpoint, beside
the tables in one base folder: a run with the base of an earlier one goes on where that
ended.  The number of state partitions is spark.sql.shuffle.partitions at the first run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType

from dossier.functions.text import is_blank
from dossier.operators import upsert
from dossier.store import delete, exists, finished, fresh_path

FAN = 8
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def file_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Runs handle(batch, number) for all that is there and waits for it."""
    with _settings(stream.sparkSession, STATE):
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
        query.awaitTermination()


class Runs:
    """Runs of a table in a folder, and how runs are merged: merge(rows) of a union is that of the merges of its parts."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, merge: Callable[[DataFrame], DataFrame], fan: int | None = None) -> None:
        self.spark, self.folder, self.schema, self.merge, self.fan = spark, folder, schema, merge, fan or FAN

    def _named(self) -> dict[str, tuple[int, int, int]]:
        """Level, first and last number of each finished run: 7 is the one of number 7, 2-1-64 one of level 2."""
        names = {n: n.split("-") for n in finished(self.spark, self.folder)}
        return {n: (0, int(p[0]), int(p[0])) if len(p) == 1 else tuple(map(int, p)) for n, p in names.items() if len(p) in (1, 3) and all(x.isdigit() for x in p)}

    def live(self) -> list[tuple[int, int, int, str]]:
        """The runs that no finished run of a higher level holds, in order of their numbers."""
        named = self._named()
        held = lambda run: any(other[0] > run[0] and other[1] <= run[1] and run[2] <= other[2] for other in named.values())
        return sorted(((*run, name) for name, run in named.items() if not held(run)), key=lambda r: r[1])

    def add(self, number: int, rows: DataFrame) -> None:
        """The run of this number, instead of one that a failed batch may have left; runs of a full level become one."""
        self.merge(rows).write.mode("overwrite").parquet(f"{self.folder}/{number}")
        while True:
            runs = self.live()
            full = [level for level in {r[0] for r in runs} if sum(r[0] == level for r in runs) >= self.fan]
            if not full:
                return
            own = [r for r in runs if r[0] == min(full)]
            merged = self.merge(self._read([r[3] for r in own]))
            merged.write.mode("overwrite").parquet(f"{self.folder}/{min(full) + 1}-{own[0][1]}-{own[-1][2]}")

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{n}" for n in names)) if names else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self.merge(self._read([r[3] for r in self.live()]))

    def vacuum(self) -> None:
        """Deletes the runs that others hold; tables that were read before lose their files."""
        live = {r[3] for r in self.live()}
        for name in self._named().keys() - live:
            delete(self.spark, f"{self.folder}/{name}")


def _last_rows(keys: Sequence[str], compared: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Of rows with first_seen_at and last_seen_at the snapshot: each key's fields at its last position."""

    def merge(rows: DataFrame) -> DataFrame:
        merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*compared), "last_seen_at").alias("_last"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
        return merged.select(*keys, *(F.col("_last")[c].alias(c) for c in compared), "first_seen_at", "last_seen_at")

    return merge


class _Compared(StatefulProcessor):
    """Compares each row with its key's row before it; rows behind one that came earlier get no status."""

    def __init__(self, columns: Sequence[str], position: str, kind: str) -> None:
        self.columns, self.position, self.kind = list(columns), position, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"position {self.kind}, content string")

    def handleInputRows(self, key, rows, timerValues):
        before = self.last.get()
        now = before
        for r in sorted(rows, key=lambda r: r[self.position]):
            if r["_bad"]:
                status = "failed"
            elif now is not None and r[self.position] <= now[0]:
                status = None
            else:
                status = "new" if now is None else "existing" if now[1] == r["_content"] else "updated"
                now = (r[self.position], r["_content"])
            yield Row(**{c: r[c] for c in self.columns}, status=status)
        if now is not before:
            self.last.update(now)

    def close(self) -> None:
        pass


def snapshot_stream(stream: DataFrame, keys: Sequence[str], compared: Sequence[str], position: str, required: Sequence[str] = (), base: str | None = None) -> DataFrame:
    """The last snapshot alone: keys, compared, first_seen_at, last_seen_at as upsert_stream has them, without state."""
    spark = stream.sparkSession
    base = base or fresh_path(spark, "incremental")
    runs = Runs(spark, f"{base}/snapshot", _snapshot_schema(stream, keys, compared, position), _last_rows(keys, compared))
    run_available(stream, f"{base}/checkpoint", lambda batch, number: runs.add(number + 1, _seen(batch.where(~_bad(required)), keys, compared, position)))
    return _of_the_run(runs.rows())


def upsert_stream(stream: DataFrame, keys: Sequence[str], compared: Sequence[str], position: str, required: Sequence[str] = (), base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The last snapshot (keys, compared, first_seen_at, last_seen_at as positions) and the status of every row (keys, position, status).

    Rows are taken by position whatever batch they come in: a key's row with the largest position wins, first_seen_at is its
    smallest position, last_seen_at the largest of the run, and a row is compared with its key's row before it by position.
    Rows with a blank required field are failed and change nothing.  base is the folder of runs, rows and checkpoint.  A
    task holds the rows that a batch has for one key.
    """
    spark = stream.sparkSession
    base = base or fresh_path(spark, "incremental")
    kinds = {f.name: f for f in stream.schema.fields}
    given = StructType([kinds[c] for c in (*keys, *compared, position)])
    judged = StructType([*given.fields]).add("status", StringType())
    runs = Runs(spark, f"{base}/snapshot", _snapshot_schema(stream, keys, compared, position), _last_rows(keys, compared))

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        rows = spark.read.schema(judged).parquet(f"{base}/rows/batch={number}")
        runs.add(number + 1, _seen(rows.where("status IS NULL OR status <> 'failed'"), keys, compared, position))

    content = F.to_json(F.struct(*compared), {"ignoreNullFields": "false"})
    marked = stream.select(*given.names, _bad(required).alias("_bad"), content.alias("_content"))
    processor = _Compared(given.names, position, kinds[position].dataType.simpleString())
    run_available(marked.groupBy(*keys).transformWithState(processor, judged, "append", "none"), f"{base}/checkpoint", handle)
    numbers = sorted(int(n.removeprefix("batch=")) for n in finished(spark, f"{base}/rows"))
    rows = spark.read.schema(judged).parquet(*(f"{base}/rows/batch={n}" for n in numbers)) if numbers else spark.createDataFrame([], judged)
    return _of_the_run(runs.rows()), _statuses(rows, keys, compared, position)


def _bad(required: Sequence[str]):
    bad = F.lit(False)
    for c in required:
        bad = bad | is_blank(F.col(c).cast("string"))
    return bad


def _snapshot_schema(stream: DataFrame, keys: Sequence[str], compared: Sequence[str], position: str) -> StructType:
    kinds = {f.name: f for f in stream.schema.fields}
    return StructType([kinds[c] for c in (*keys, *compared)]).add("first_seen_at", kinds[position].dataType).add("last_seen_at", kinds[position].dataType)


def _seen(rows: DataFrame, keys: Sequence[str], compared: Sequence[str], position: str) -> DataFrame:
    return rows.select(*keys, *compared, F.col(position).alias("first_seen_at"), F.col(position).alias("last_seen_at"))


def _of_the_run(snapshot: DataFrame) -> DataFrame:
    """last_seen_at is the largest of all."""
    return snapshot.drop("last_seen_at").crossJoin(snapshot.agg(F.max("last_seen_at").alias("last_seen_at")))  # with one row


def _statuses(rows: DataFrame, keys: Sequence[str], compared: Sequence[str], position: str) -> DataFrame:
    """The statuses as they were given, but for the keys with rows that came late: these are judged again."""
    late = rows.where("status IS NULL").select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    done = rows.select(*keys, position, "status")
    if late.isEmpty():
        return done
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    of_late = rows.where("status IS NULL OR status <> 'failed'").join(late, same, "left_semi")
    none = of_late.select(*keys, *compared).limit(0)
    again = upsert.batch_status(none, of_late.drop("status"), keys, compared, position)
    return done.where("status = 'failed'").unionByName(done.where("status IS NULL OR status <> 'failed'").join(late, same, "left_anti")).unionByName(again)


def once_only(stream: DataFrame, keys: Sequence[str], base: str | None = None) -> DataFrame:
    """Each key's first row, across batches and runs with the same base; the keys that were delivered are state on disk."""
    spark = stream.sparkSession
    base = base or fresh_path(spark, "delivered")
    with _settings(spark, STATE):
        new = stream.dropDuplicates(list(keys))
        query = new.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{base}/rows").start()
        query.awaitTermination()
    if not exists(spark, f"{base}/rows"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
