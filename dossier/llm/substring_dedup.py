"""Substring dedup with a count-min prefilter.

A window is a run of 50 consecutive words of one document.  A word goes when
some window over it also starts in a document with a smaller doc_id.

1. Documents are dealt into groups by a hash of the row.  Each group counts its
   windows (once a document) in a sparse count-min sketch and sends the counters
   that it hit, about a byte each, to their ranges.  Merging a range adds up,
   saturating at two, and answers each group with one bit a counter that it
   sent: "two or more".  No task holds the sketch, and it has counters_per_window
   counters a window and row however large the corpus is.
2. Each group sends the windows which all rows of the merged sketch call
   repeated, once each with the smallest doc_id that it has for it.  A reducer
   for each slice of the hash space groups them exactly (by 128 bits) and answers
   with one bit an entry: some other group has a smaller doc_id.
3. The groups put the bits beside their windows and drop the covered words.

The sketch never underestimates, so that no repeated window is lost; what it
lets through for nothing, about an eighth of the windows, costs an entry in step 2.
A window that very many documents share makes one entry a group, not a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import words

ROWS = 2
SHARD = 1 << 22  #: counters of a range of the sketch: what is merged together, twice that or more with many of them
MOST_SHARD = 1 << 25
NO_ID = np.iinfo(np.int64).max  #: stands for a null doc_id, which is larger than any other
_U = np.uint64

OUTPUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
HITS = pa.schema([("part", pa.int64()), ("grp", pa.int64()), ("blob", pa.binary())])


def _counters(h1: np.ndarray, h2: np.ndarray, row: int, n: int) -> np.ndarray:
    return words.mix(h1 + h2 * _U(2 * row + 1)) % _U(n)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _packed(steps: np.ndarray) -> bytes:
    """Steps in one, two or four bytes each, whichever is shortest; the first byte tells.  Where it is one, bytes of 255 add up to the next one that is not."""
    more = steps // 255
    if int(more.sum()) < len(steps):
        out = np.full(int(more.sum()) + len(steps), 255, dtype=np.uint8)
        out[np.cumsum(more + 1) - 1] = steps % 255
        return b"\x01" + out.tobytes()
    width = np.uint16 if int(steps.max()) < 1 << 16 else np.uint32
    return bytes([width().itemsize]) + steps.astype(width).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32}[blob[0]], offset=1)
    at = np.cumsum(steps, dtype=np.int64)
    return at[steps != 255] if blob[0] == 1 else at


class _Windows:
    """The windows of a group of documents."""

    def __init__(self, docs: pa.Table, size: int) -> None:
        ids = _ids(docs.column("doc_id"))
        self.chunks: list[tuple[words.Chunk, np.ndarray, slice]] = []
        parts: list[tuple[np.ndarray, ...]] = []
        total = done = 0
        for chunk in words.chunks(docs.column("text")):
            first, second = chunk.both_hashes()
            h1, at = words.windows(first, chunk.doc_words, size)
            h2, _ = words.windows(second, chunk.doc_words, size, key=1)
            del first, second
            row = chunk.first + chunk.doc_of_word()[at]
            parts.append((h1, h2, row, ids[row]))
            self.chunks.append((chunk, at, slice(total, total + len(at))))
            total, done = total + len(at), done + len(chunk)
        kinds = (np.uint64, np.uint64, np.int64, np.int64)
        self.h1, self.h2, self.row, self.doc = (np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds))

    def hits(self, row: int, n_counters: int, shard: int) -> tuple[np.ndarray, Iterator[tuple[int, slice]], np.ndarray]:
        """The distinct counters that a row of the sketch counts up, where each range of them lies, and which of them are hit by two documents here."""
        counter = _counters(self.h1, self.h2, row, n_counters)
        order = np.argsort(counter, kind="stable")
        c, d = counter[order], self.row[order]
        new = np.ones(len(c), dtype=bool)
        new[1:] = c[1:] != c[:-1]
        other = np.zeros(len(c), dtype=bool)
        other[1:] = ~new[1:] & (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        twice = np.add.reduceat(other, first, dtype=np.int64) > 0 if len(c) else np.zeros(0, bool)
        own = c[new].astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(own // shard)) + 1).tolist(), len(own)]
        return own, ((int(own[a]) // shard, slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a), twice


def _hit(size: int, n_counters: int, shard: int):
    """A group's sparse counters: for each row and range the steps from counter to counter; a step of 0 says that one counts two or more."""

    def run(docs: pa.Table) -> pa.Table:
        own = _Windows(docs, size)
        out: dict[str, list] = {"part": [], "grp": [], "blob": []}
        for row in range(ROWS):
            counters, ranges, twice = own.hits(row, n_counters, shard)
            for k, part in ranges:
                again = np.repeat(counters[part], 1 + twice[part])
                out["part"].append(k * ROWS + row)
                out["blob"].append(_packed(np.diff(again, prepend=k * shard - 1)))
        out["grp"] = [docs.column("grp")[0].as_py()] * len(out["part"])
        return pa.table(out, schema=HITS)

    return run


def _merged(shard: int):
    """All groups' counters of a range -> for each group one bit a counter that it sent: it counts two or more."""

    def run(table: pa.Table) -> pa.Table:
        count = np.zeros(shard, dtype=np.uint8)
        sent = table.column("blob")

        def counters(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
            at = _unpacked(blob) - 1
            again = np.zeros(len(at), dtype=bool)
            again[1:] = at[1:] == at[:-1]
            return at[~again], at[again]

        for blob in sent:
            once, twice = counters(blob.as_py())
            count[once] = np.minimum(count[once] + 1, 2)
            count[twice] = 2
        bits = [np.packbits(count[counters(blob.as_py())[0]] == 2).tobytes() for blob in sent]
        return pa.table({"part": table.column("part"), "grp": table.column("grp"), "blob": pa.array(bits, pa.binary())}, schema=HITS)

    return run


class _Candidates(_Windows):
    """The windows of a group of documents that the sketch calls repeated."""

    def __init__(self, docs: pa.Table, said: pa.Table, size: int, n_counters: int, shard: int, n_slices: int) -> None:
        super().__init__(docs, size)
        bits = dict(zip(said.column("part").to_pylist(), said.column("blob"), strict=True))
        keep = np.ones(len(self.h1), dtype=bool)
        for row in range(ROWS):
            counters, ranges, _ = self.hits(row, n_counters, shard)
            often = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(bits[k * ROWS + row].as_py(), np.uint8), count=part.stop - part.start).astype(bool) for k, part in ranges)])
            keep &= often[np.searchsorted(counters, _counters(self.h1, self.h2, row, n_counters).astype(np.int64))] if len(often) else False
        total = 0
        for i, (chunk, at, part) in enumerate(self.chunks):
            at = at[keep[part]]
            self.chunks[i] = chunk, at, slice(total, total + len(at))
            total += len(at)
        h1, h2, self.doc = self.h1[keep], self.h2[keep], self.doc[keep]
        in_slice = ((h2 >> _U(32)) * _U(n_slices)) >> _U(32)
        order = np.lexsort((self.doc, h2, h1, in_slice))
        h1, h2, in_slice, doc_sorted = h1[order], h2[order], in_slice[order], self.doc[order]
        new = np.ones(total, dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.key_of = np.empty(total, dtype=np.int64)  #: which of the distinct windows each one is
        self.key_of[order] = np.cumsum(new) - 1
        self.h1, self.h2, self.slice, self.least = h1[new], h2[new], in_slice[new], doc_sorted[new]

    def by_slice(self) -> Iterator[tuple[int, slice]]:
        cuts = [0, *(np.flatnonzero(np.diff(self.slice)) + 1), len(self.slice)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(self.slice[a]), slice(a, b)


def _requests(size: int, n_counters: int, shard: int, n_slices: int):
    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        out: dict[str, list] = {"slice": [], "grp": [], "n": [], "keys": []}
        if docs.num_rows:
            found = _Candidates(docs, said, size, n_counters, shard, n_slices)
            group = docs.column("grp")[0].as_py()
            for s, part in found.by_slice():
                least = found.least[part]
                narrow = not len(least) or int(least.min()) >= 0 and int(least.max()) < 1 << 32
                out["slice"].append(s)
                out["grp"].append(group)
                out["n"].append(part.stop - part.start)
                out["keys"].append(bytes([narrow]) + found.h1[part].tobytes() + found.h2[part].tobytes() + least.astype(np.uint32 if narrow else np.int64).tobytes())
        return pa.table(out, schema=pa.schema([("slice", pa.int64()), ("grp", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())]))

    return run


def _answers(table: pa.Table) -> pa.Table:
    """For each entry of a slice one bit: some other group has a smaller doc_id for its window."""
    sizes = table.column("n").to_numpy()
    h1, h2, least = [], [], []
    for n, blob in zip(sizes, table.column("keys").to_pylist(), strict=True):
        h1.append(np.frombuffer(blob, np.uint64, n, 1))
        h2.append(np.frombuffer(blob, np.uint64, n, 1 + 8 * n))
        least.append(np.frombuffer(blob, np.uint32 if blob[0] else np.int64, n, 1 + 16 * n).astype(np.int64))
    a, b, doc = np.concatenate(h1), np.concatenate(h2), np.concatenate(least)
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    smallest = doc[new][np.cumsum(new) - 1]
    beaten = np.empty(len(a), dtype=bool)
    beaten[order] = doc > smallest
    ends = np.cumsum(sizes)
    bits = [np.packbits(beaten[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
    return pa.table({"part": pa.array(-1 - table.column("slice").to_numpy()), "grp": table.column("grp"), "blob": pa.array(bits, pa.binary())}, schema=HITS)


def _removal(size: int, n_counters: int, shard: int, n_slices: int, with_text: bool):
    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        n = docs.num_rows
        n_words, n_removed = np.zeros(n, np.int64), np.zeros(n, np.int64)
        digests: list[str] = [""] * n
        kept_texts: list[str] = [""] * n
        if n:
            found = _Candidates(docs, said, size, n_counters, shard, n_slices)
            bits = {-1 - k: b for k, b in zip(said.column("part").to_pylist(), said.column("blob"), strict=True) if k < 0}
            beaten = np.zeros(len(found.h1), dtype=bool)
            for s, part in found.by_slice():
                beaten[part] = np.unpackbits(np.frombuffer(bits[s].as_py(), np.uint8), count=part.stop - part.start).astype(bool)
            gone = beaten[found.key_of] | (found.doc > found.least[found.key_of])
            for chunk, at, part in found.chunks:
                change = np.zeros(len(chunk.starts) + 1, dtype=np.int32)
                first = at[gone[part]]
                np.add.at(change, first, 1)
                np.add.at(change, first + size, -1)
                keep = np.cumsum(change[:-1]) == 0
                removed = words.prefix((~keep).astype(np.int64))
                d, own = chunk.doc_words, slice(chunk.first, chunk.first + len(chunk))
                n_words[own] = np.diff(d)
                n_removed[own] = removed[d[1:]] - removed[d[:-1]]
                for i, text in enumerate(chunk.joined(keep), chunk.first):
                    digests[i] = hashlib.sha256(text).hexdigest()
                    if with_text:
                        kept_texts[i] = str(text, "utf-8", "replace")
        out = {"doc_id": docs.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words), "n_removed": pa.array(n_removed), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            out["kept_text"] = pa.array(kept_texts, pa.string())
        return pa.table(out)

    return run


def substring_dedup(docs: DataFrame, *, size: int = 50, counters_per_window: float = 2.2, max_counters: int | None = None, group_bytes: int = 4 << 20, slice_entries: int = 300_000, with_text: bool = False) -> DataFrame:
    """One row a document of (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    Null or empty text: no words.  Null doc_id: larger than every other, and a null does not beat a null.  Rows that
    share a doc_id don't remove each other's words.  Other columns of docs are ignored; an empty table gives none.  A very
    long text is one group's work and takes about 15 bytes of a task's memory a byte.  max_counters bounds the sketch for
    tests: with fewer counters more windows pass it, and the result is the same.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    wanted = int(counters_per_window * n_bytes / 6)
    shard = min(MOST_SHARD, max(SHARD, wanted >> 5))
    n_counters = max(1, min(max_counters or wanted, wanted) // shard) * shard
    groups = 1 + n_bytes // group_bytes
    n_slices = int(1 + n_bytes // 6 // slice_entries // 2)

    dealt = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    by_group = dealt.groupBy("grp")
    hits = "part long, grp long, blob binary"
    often = by_group.applyInArrow(_hit(size, n_counters, shard), hits).groupBy("part").applyInArrow(_merged(shard), hits)
    requests = by_group.cogroup(often.groupBy("grp")).applyInArrow(_requests(size, n_counters, shard, n_slices), "slice long, grp long, n long, keys binary")
    answers = requests.groupBy("slice").applyInArrow(_answers, hits)
    return by_group.cogroup(often.union(answers).groupBy("grp")).applyInArrow(_removal(size, n_counters, shard, n_slices, with_text), OUTPUT + (", kept_text string" if with_text else ""))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP1_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT r, doc_id, unnest(list_transform(range(1, len(words) - 48), lambda i: {'k': i, 'h': md5(array_to_string(words[i:i + 49], ' '))}), recursive := true) FROM w),
least AS (SELECT h, min(doc_id) AS first_id FROM s GROUP BY h),
hit AS (SELECT r, k, TRUE AS starts FROM s JOIN least USING (h) WHERE doc_id > first_id),
t AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w),
c AS (SELECT r, word, k, coalesce(bool_or(starts) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), FALSE) AS covered FROM t LEFT JOIN hit USING (r, k)),
d AS (SELECT r, count(*) AS n, count(*) FILTER (covered) AS gone, string_agg(word, ' ' ORDER BY k) FILTER (NOT covered) AS kept FROM c GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN d USING (r)
"""
