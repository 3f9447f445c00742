"""Updates of a chat as a streaming source over landed files.

Update files hold one JSON object a line; they don't change once they have landed, and
later ones have names that sort after earlier ones.  The offset is the last name, kept
in the query's checkpoint, so that a run that goes on opens new files only.  A line
that is no update is a row with its error: it stops nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from dossier.functions.text import callback_id
from dossier.store import finished, fresh_path
from dossier.streaming.incremental import run_available

UPDATE = "update_id long, callback_id string, chat_id string, data string, error string, file string, line long"
FORMAT = "landed_updates"


def _files(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def landed(path: str) -> list[str]:
    """Names of the files that have landed, in order."""
    from pyarrow import fs

    system, folder = _files(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def parsed(line: str) -> tuple:
    """update_id, callback_id, chat_id, data and error of a line; an update of another kind has ids of none."""
    try:
        update = json.loads(line)
    except ValueError:
        return None, None, None, None, "not JSON"
    if not isinstance(update, dict):
        return None, None, None, None, "not an object"
    number = update.get("update_id")
    if isinstance(number, bool) or not isinstance(number, int) or not -(1 << 63) <= number < 1 << 63:
        return None, None, None, None, "no update_id"
    query = update.get("callback_query")
    if query is None:
        return number, None, None, None, None
    if not isinstance(query, dict):
        return number, None, None, None, "callback_query is no object"
    message = query.get("message")
    chat = message.get("chat") if isinstance(message, dict) else None
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    data = query.get("data")
    return number, text(query.get("id")), text(chat.get("id") if isinstance(chat, dict) else None), data if isinstance(data, str) else None, None


class _File(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(landed(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(n) for n in landed(self.path) if start["after"] < n <= end["after"]]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, folder = _files(self.path)
        with system.open_input_stream(f"{folder}/{partition.name}") as stream:
            rest, number = b"", 0
            while block := stream.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    number += 1
                    yield from self._row(line, partition.name, number)
            yield from self._row(rest, partition.name, number + 1)

    def _row(self, line: bytes, name: str, number: int) -> Iterator[tuple]:
        if line.strip():
            yield (*parsed(line.decode("utf-8", "replace")), name, number)


class LandedUpdates(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return UPDATE

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])


def update_stream(spark: SparkSession, path: str) -> DataFrame:
    """The UPDATE rows of the files that land in a folder."""
    spark.dataSource.register(LandedUpdates)
    return spark.readStream.format(FORMAT).load(path)


def callback_outcome(allowed_chat: Column, delivery_status: Column, version_matches: Column) -> Column:
    """What an accepted update (callback_id, chat_id, data) comes to; null for an update without a callback.

    delivery_status and version_matches are of the delivery that its data names.
    """
    data = F.col("data")
    return (
        F.when(F.col("error").isNotNull() | (F.col("callback_id").isNull() & F.col("chat_id").isNull() & data.isNull()), None)
        .when(F.coalesce(F.col("callback_id"), F.lit("")) == "", "ignored_no_id")
        .when(~F.coalesce(F.col("chat_id"), F.lit("None")).eqNullSafe(allowed_chat.cast("string")), "forbidden_chat")
        .when(data.isNull() | ~data.startswith("full:"), "unknown_prefix")
        .when(callback_id(data).isNull(), "bad_callback_data")
        .when(~F.coalesce(delivery_status == "sent", F.lit(False)), "delivery_not_found")
        .when(~F.coalesce(version_matches, F.lit(False)), "version_unavailable")
        .otherwise("answered")
    )


def received(spark: SparkSession, path: str, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) updates of all files so far; an update_id counts once, and a run with the base of an earlier one opens new files only.

    A refused line is a row of its own and changes nothing else.
    """
    base = base or fresh_path(spark, "updates")
    stream = update_stream(spark, path)
    names = stream.columns
    once = F.when(F.col("error").isNull(), F.col("update_id").cast("string")).otherwise(F.concat("file", F.lit("#"), F.col("line").cast("string")))
    new = stream.withColumn("_once", once).dropDuplicates(["_once"]).select(*names)
    run_available(new, f"{base}/checkpoint", lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/rows/{number}"))
    done = [f"{base}/rows/{n}" for n in finished(spark, f"{base}/rows")]
    rows = spark.read.schema(UPDATE).parquet(*done) if done else spark.createDataFrame([], UPDATE)
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL")
