"""Texts looked for in all others, which are read once whatever the number of texts looked for.

A text of at least b and fewer than 2b bytes, b a power of two, stands where its first b
bytes do and its last b bytes end at the right place.  Hashes of the windows of 1, 2, 4, ...
bytes come from those of half the length.  A bitset of what is asked, of bounded size, says
which windows may begin a text and which spans may be one.  It lets more through than there
is, the fuller the more, but never less; what it lets through is told apart by its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_U = np.uint64
_ODD = [_U(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]  #: also the probes of a hash
SECTION = 15  #: power of two: bits of a row of the bitset, as Spark makes it
LEAST_BITS = 20  #: power of two
STRETCH = 1 << 19  #: bytes whose windows are hashed at a time


def _merged(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    x = first * _ODD[1]
    x ^= x >> _U(31)
    x += last
    x *= _ODD[2]
    x ^= x >> _U(29)
    return x


def _levels(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(b, hashes of the windows of b bytes by their first place) up to the longest; up to 8 bytes a hash is the bytes themselves."""
    b, h = 1, data.astype(_U)
    while len(h):
        yield b, h
        if 2 * b > longest:
            return
        h = h[:-b] | h[b:] << _U(8 * b) if b < 8 else _merged(h[:-b], h[b:])
        b *= 2


def _span(first: np.ndarray, last: np.ndarray, length) -> np.ndarray:
    """Hashes of spans by those of their first and last windows and their lengths."""
    return _merged(first ^ (length * _ODD[3]), last)


def _bits_of(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for odd in _ODD:
        yield ((h * odd) >> _U(64 - bits)).view(np.int64)


def _passed(h: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes that the bitset may hold."""
    at = np.arange(0)
    for k, odd in enumerate(_ODD):
        bit = (((h[at] if k else h) * odd) >> _U(64 - bits)).view(np.int64)
        good = np.flatnonzero((held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
        at = at[good] if k else good
    return at


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, one text after the other, and where each begins, with the end of all."""
    column = column.cast(pa.large_binary())
    place = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[place[0] : place[-1]]
    return data, place - place[0]


def _bitset(asked: DataFrame, text: str, longest: int, bits: int) -> np.ndarray:
    """The bits of the beginnings of texts and of the texts as wholes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, place = _bytes(batch.column(0))
            a = 0
            while a + 1 < len(place):
                z = max(a + 1, int(np.searchsorted(place, place[a] + STRETCH, "right")) - 1)
                start, length = place[a:z] - place[a], np.diff(place[a : z + 1])
                for b, h in _levels(data[place[a] : place[z]], longest):
                    own = np.flatnonzero((length >= b) & (length < 2 * b))
                    first, last = h[start[own]], h[start[own] + length[own] - b]
                    every = [bit for x in (first, _span(first, last, length[own].astype(_U))) for bit in _bits_of(x, bits)]
                    bit = np.unique(np.concatenate(every))
                    yield pa.RecordBatch.from_arrays([pa.array(bit >> SECTION), pa.array(bit & ((1 << SECTION) - 1))], names=["section", "bit"])
                a = z

    made = asked.select(text).mapInArrow(run, "section long, bit long").groupBy("section").agg(F.bitmap_construct_agg("bit").alias("data"))
    size = 1 << SECTION >> 3
    held = np.zeros(max(1 << bits >> 3, size), np.uint8)
    for section, data in made.collect():
        held[section * size : (section + 1) * size] = np.frombuffer(data, np.uint8)
    return held


def _distinct(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A place of each (owner, first, last)."""
    order = np.lexsort((last, first, owner))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([np.diff(x[order]) != 0 for x in (owner, first, last)])
    return order[new]


def _stretches(data: np.ndarray, place: np.ndarray, lengths: dict[int, list[int]], held: np.ndarray, bits: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """For each stretch of bytes, what the bitset lets through: numbers of texts, and bytes that they hold; for a text the same bytes once."""
    longest = max(map(max, lengths.values()))
    seen: set[tuple[int, bytes]] = set()
    for a in range(0, len(data), STRETCH):
        owners, pieces = [], []
        for b, h in _levels(data[a : a + STRETCH + longest - 1], longest):
            if b not in lengths:
                continue
            at = _passed(h[:STRETCH], held, bits)
            owner = np.searchsorted(place, at + a, "right") - 1
            room = place[owner + 1] - a - at
            most = room.max(initial=0)
            for length in lengths[b]:
                if length > most:
                    break
                fits = np.flatnonzero(room >= length)
                first, last = h[at[fits]], h[at[fits] + (length - b)]
                good = _passed(_span(first, last, _U(length)), held, bits)
                if b <= 8:
                    good = good[_distinct(owner[fits[good]], first[good], last[good])]
                for i, k in zip((at[fits[good]] + a).tolist(), owner[fits[good]].tolist(), strict=True):
                    piece = data[i : i + length].tobytes()
                    if (k, piece) not in seen:
                        seen.add((k, piece))
                        owners.append(k)
                        pieces.append(piece)
        yield owners, pieces
        goes_on = int(np.searchsorted(place, a + STRETCH, "right")) - 1
        seen = {x for x in seen if x[0] == goes_on}


def holders(asked: DataFrame, texts: DataFrame, quote: str, key: str, text: str, most_bytes: int) -> DataFrame:
    """(key, quote as binary): texts (key, text) with what they hold of asked (quote), each once a row of texts; some that nobody asked for may be among them.

    Blank and null quotes and texts have no rows.  The bitset has up to most_bytes.
    """
    spark = asked.sparkSession
    asked, texts = asked.where(F.octet_length(quote) > 0).select(quote), texts.select(key, text)
    schema = StructType([texts.schema[key]]).add(quote, "binary")
    counted = {r[0]: r[1] for r in asked.groupBy(F.octet_length(quote)).agg(F.approx_count_distinct(quote)).collect()}
    if not counted:
        return spark.createDataFrame([], schema)
    bits = min((8 * most_bytes).bit_length() - 1, max(LEAST_BITS, (64 * sum(counted.values())).bit_length()))
    lengths: dict[int, list[int]] = {}
    for n in sorted(counted):
        lengths.setdefault(1 << n.bit_length() - 1, []).append(n)
    shared = spark.sparkContext.broadcast(_bitset(asked, quote, max(counted), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())  # here, so that Spark works a text out once
            for owners, pieces in _stretches(*_bytes(batch.column(1)), lengths, shared.value, bits):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array(pieces, pa.binary())], names=[key, quote])

    return texts.mapInArrow(run, schema)
