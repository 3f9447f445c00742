"""WARC archives with revisit records, and a merged index of their captures.

Writing: pages with equal payloads share one response record, that of the
smallest page_id, and the others are revisit records.  Each Spark task writes an
archive of its own through Spark's text sink, whose line separator is the end of
a WARC record, so that any store that Spark writes to will do.

Reading: archives give index entries, and revisits find their response by the record
id that they refer to.  Each task sorts runs of bounded size by URL key, timestamp and
page_id and cuts them at key ranges, taken from the quantiles of a sample, into packed
blocks.  A key range merges its pieces of all runs with a loser tree, which unpacks a
block of a run when it gets there; the ranges, and the rows inside, are in global
order.  The cuts compare whole entries, so that a URL with very many captures spreads
over ranges.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.scratch import fresh_path, stored

END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "url_key string, stamp string, page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_record string, archive string, at long"
INDEX = "url_key string, stamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"


def capture_records(pages: DataFrame, *, least_bytes: int = 100) -> DataFrame:
    """One row a page of (page_id, url, html): url_key, and its whole WARC record without the separator that ends it.

    Null html is an empty payload.  Equal payloads of at least least_bytes are revisits of the smallest page_id's; rows
    with that same page_id are responses all.  A page without page_id is a response only where no page with one has its payload.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"payload_digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("long")})
    own = F.struct("page_id", "url")
    firsts = page.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), own)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    # short payloads are no key that many rows share
    key = F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    page = page.withColumn("_key", key).join(firsts.select(F.col("payload_digest").alias("_key"), "first"), "_key", "left").drop("_key")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))

    def stamp(page_id: Column) -> Column:
        return F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(100_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def record_id(page_id: Column, url: Column) -> Column:
        identity = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), "payload_digest", url))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(identity, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))

    plain = lambda url: F.regexp_replace(url, r"[\r\n]", "%0A")
    referred = F.concat(
        F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("first.page_id"), F.col("first.url")),
        F.lit("\r\nWARC-Refers-To-Target-URI: "), plain(F.col("first.url")), F.lit("\r\nWARC-Refers-To-Date: "), stamp(F.col("first.page_id")),
    )
    body_bytes = F.lit(len(HTTP_HEAD)) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id"), F.col("url")),
        F.lit("\r\nWARC-Date: "), stamp(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), plain(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, referred).otherwise(F.lit("")),
        F.lit("\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), body_bytes.cast("string"), F.lit(END),
    )
    body = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("html")))
    return page.select(F.concat(header, body).alias("value"))


def write_warc(pages: DataFrame, path: str, *, compression: str = "gzip", archive_bytes: int = 32 << 20, least_bytes: int = 100) -> None:
    """Archives of about archive_bytes in a folder.  gzip compresses an archive as a whole; with none, the index's places are byte offsets in the file."""
    mean = pages.agg(F.coalesce(F.avg(F.octet_length("html")), F.lit(0.0))).first()[0] + 500
    records = capture_records(pages, least_bytes=least_bytes)
    records.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", max(1, int(archive_bytes / mean))).text(path)


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, in lower case; no scheme, port, www or fragment."""
    rest = url.split("#", 1)[0].split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host = host.split("@")[-1].split(":")[0].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (slash + path).lower()


def _records(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """Place, headers and block of each record of an archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        length = int(headers["Content-Length"])
        block = view[stop + 4 : stop + 4 + length]
        after = stop + 4 + length
        if len(block) < length or data[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        yield at, headers, block
        at = after + 4


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives -> their index entries in the order of the archive; each payload is checked against its digest."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            if data[:2] == b"\x1f\x8b":
                data = zlib.decompress(data, 31)
            entries = []
            for at, head, block in _records(data):
                digest, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), None
                if head["WARC-Type"] == "response":
                    payload = block[len(HTTP_HEAD) :]
                    n = len(payload)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: the payload of the record at {at} is damaged")
                page_id = int(head["X-Page-Id"]) if head["X-Page-Id"] else None
                entries.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], page_id, n, digest, head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To"), path.rsplit("/", 1)[-1], at))
                if len(entries) == 20_000:
                    yield _columns(entries, ENTRY)
                    entries = []
            if entries:
                yield _columns(entries, ENTRY)


def _columns(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [c.split() for c in ddl.split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in fields])


def _blocks(cuts: list[tuple], run_rows: int, block_rows: int):
    """Index rows -> sorted runs, cut at the key ranges into packed blocks: span, run, place of the block in its run, and the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, runs, rows = TaskContext.get().partitionId(), 0, []

        def packed() -> pa.RecordBatch:
            rows.sort(key=_key)
            out: dict[str, list] = {"span": [], "run": [], "seq": [], "block": []}
            edges = [0, *(bisect.bisect_left(rows, c, key=_key) for c in cuts), len(rows)]
            for span, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                for k in range(a, b, block_rows):
                    sink = pa.BufferOutputStream()
                    block = _columns(rows[k : min(b, k + block_rows)], INDEX)
                    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                        stream.write_batch(block)
                    for name, value in (("span", span), ("run", (task << 32) + runs), ("seq", k), ("block", sink.getvalue().to_pybytes())):
                        out[name].append(value)
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("span", pa.int32()), ("run", pa.int64()), ("seq", pa.int64()), ("block", pa.binary())]))

        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(rows) >= run_rows:
                yield packed()
                runs, rows = runs + 1, []
        if rows:
            yield packed()

    return run


def _sizes(cuts: list[tuple]):
    """Index rows -> how many of a batch each key range holds: span, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many: dict[int, int] = {}
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                span = bisect.bisect_right(cuts, _key(entry))
                many[span] = many.get(span, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(many.keys(), pa.int32()), pa.array(many.values(), pa.int64())], names=["span", "n"])

    return run


def _key(entry: tuple) -> tuple:
    """An entry's place in the order; one without page_id comes first among its like."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[7], entry[8]


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, and the winner goes up."""

    def __init__(self, runs: list[Iterable[tuple]], key=_key) -> None:
        self.runs, self.key, self.k = [iter(r) for r in runs] or [iter(())], key, max(1, len(runs))
        self.first = [next(r, None) for r in self.runs]
        self.heads = [None if x is None else key(x) for x in self.first]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _play(self, i: int, building: bool = False) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                if building:
                    self.losers[node] = winner
                    return
            elif self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[w := self.losers[0]] is not None:
            yield self.first[w]
            self.first[w] = x = next(self.runs[w], None)
            self.heads[w] = None if x is None else self.key(x)
            self._play(w)


def _unpacked(blocks: list[pa.Scalar]) -> Iterator[tuple]:
    """The rows of a run, a block at a time."""
    for block in blocks:
        yield from zip(*(c.to_pylist() for c in pa.ipc.open_stream(block.as_py()).read_all().columns), strict=True)


def _merge(table: pa.Table) -> pa.Table:
    """The blocks of the runs in one key range -> the range's captures in order."""
    runs: dict[int, list[pa.Scalar]] = {}
    table = table.sort_by([("run", "ascending"), ("seq", "ascending")])
    for name, block in zip(table.column("run").to_pylist(), table.column("block"), strict=True):
        runs.setdefault(name, []).append(block)
    merged = _columns(list(LoserTree([_unpacked(b) for b in runs.values()])), INDEX)
    n = merged.num_rows
    return pa.table({"span": pa.array([table.column("span")[0].as_py()] * n, pa.int32()), "place": pa.array(range(n), pa.int64()), **dict(zip(merged.schema.names, merged.columns, strict=True))})


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives in a folder, unordered; a revisit has the digest's bytes and refers_to from the response whose record it names."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    entries = stored(files.mapInArrow(_entries, ENTRY), "entries")
    responses = entries.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("_bytes"))
    # what refers to nothing is no key that all responses share
    joined = entries.where("refers_to_record IS NOT NULL").join(responses, "refers_to_record", "left").withColumn("payload_bytes", F.col("_bytes"))
    plain = entries.where("refers_to_record IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    names = [c.split()[0] for c in INDEX.split(", ")]
    return plain.select(*names).union(joined.select(*names))


def capture_histories(spark: SparkSession, path: str, *, rows_a_span: int = 50_000, least_sampled: int = 20_000, sampled_a_span: int = 8, run_rows: int = 100_000, block_rows: int = 4096) -> DataFrame:
    """The captures of all archives in a folder: history_place (from 0, in their global order), span and place inside it, then the index's columns.

    A page without page_id comes first among its like; equal captures are in the order of their archives; a folder without
    records gives none.  Ranges hold about rows_a_span rows each, however many captures there are: the driver gets
    sampled_a_span keys a range, least_sampled at least.
    """
    index = stored(capture_index(spark, path), "index")
    n = index.count()
    spans = max(1, n // rows_a_span)
    cuts: list[tuple] = []
    if spans > 1:
        wanted = max(least_sampled, sampled_a_span * spans)
        chance = min(1.0, wanted / n)
        sampled = index.where(F.pmod(F.xxhash64("page_id", "archive", "at"), F.lit(1 << 20)) < F.lit(int(chance * (1 << 20)) + 1))
        keys = sorted(_key(tuple(r)) for r in sampled.limit(4 * wanted).collect())
        cuts = [keys[i * len(keys) // spans] for i in range(1, spans)] if keys else []
    blocks = index.mapInArrow(_blocks(cuts, run_rows, block_rows), "span int, run long, seq long, block binary")
    merged = blocks.groupBy("span").applyInArrow(_merge, f"span int, place long, {INDEX}")
    sizes = index.mapInArrow(_sizes(cuts), "span int, n long").groupBy("span").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("span")) - F.col("n")  # a row for each range
    starts = sizes.select("span", before.alias("_start"))
    return merged.join(starts, "span").select((F.col("_start") + F.col("place")).alias("history_place"), *merged.columns)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return capture_histories(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "history_place")


OP7_SQL = r"""
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
         octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, regexp_replace(split_part(coalesce(url, ''), '#', 1), '^.*?://', '') AS rest
  FROM pages),
judged AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id,
         regexp_replace(split_part(regexp_replace(lower(split_part(rest, '/', 1)), '^.*@', ''), ':', 1), '^www[.]', '') AS host
  FROM page),
placed AS (
  SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN contains(rest, '/') THEN lower(substr(rest, strpos(rest, '/'))) ELSE '' END AS url_key FROM judged)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
       row_number() OVER (ORDER BY url_key, page_id % 100000000, page_id) - 1 AS history_place
FROM placed
"""
