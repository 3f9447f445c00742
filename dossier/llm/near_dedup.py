"""Near-duplicate documents by Order MinHash.

A document's five-word shingles are labelled with how often they occurred before.
A sketch takes the two labelled shingles with the smallest hashes in the order
of the text, so that it depends on content and order; twenty bands of two
sketches give candidates.  A pair is verified by aligning the two sequences of
labelled shingles: the longest chain of common shingles in the same order, within
the band of shifts that the threshold allows, over the union is their similarity,
an edit-sensitive Jaccard coefficient of 0.8 or more.

Texts with the same words are one node.  In each bucket of a band all members are
aligned with one pivot, not with each other.  In buckets that still hold several
classes the pairs between them are decided as well: listed one by one in small
buckets, and in large ones in tiles of bounded size, where the numbers of shared
shingles of all pairs bound their similarity at once and only pairs that can reach
the threshold are aligned; a tile returns no more links than join its classes.  So
all links of a bucket count without a row for each pair of a large group.  At a
similarity of 0.8 the twenty bands miss a pair about once in 20,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import words
from dossier.llm.components import components
from dossier.llm.scratch import dropped, stored

_U = np.uint64
_TOP = np.iinfo(np.uint64).max


def labelled_shingles(chunk: words.Chunk, size: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Both hashes of the shingles with their occurrence numbers; offsets of the documents; both hashes of all words."""
    h = chunk.both_hashes()
    (shingle, at), (second, _) = (words.windows(x, chunk.doc_words, size, key) for key, x in enumerate(h))
    doc = chunk.doc_of_word()[at]
    order = np.argsort(shingle, kind="stable")
    s, t, d = shingle[order], second[order], doc[order]
    if ((s[1:] == s[:-1]) & (t[1:] != t[:-1])).any():
        order = np.lexsort((doc, second, shingle))
        s, t, d = shingle[order], second[order], doc[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    nth = np.arange(len(s)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(s) else np.zeros(0, np.int64)
    label = np.empty(len(s), dtype=np.uint64)
    label[order] = nth.astype(np.uint64)
    return [words.mix(x + label * _U(0x9E3779B97F4A7C15)) for x in (shingle, second)], np.searchsorted(doc, np.arange(len(chunk) + 1)), h


def order_sketches(labels: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n sketches a document with shingles: the two smallest under a hash, in text order."""
    full = np.flatnonzero(np.diff(offsets))
    starts, lengths = offsets[:-1][full], np.diff(offsets)[full]
    out = np.zeros((len(full), n), dtype=np.uint64)
    if not len(full):
        return out
    odd = words.mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
    for k in range(n):
        v = labels * odd[k]
        v ^= v >> _U(32)
        place = []
        for _ in range(2):
            least = np.minimum.reduceat(v, starts)
            hit = np.flatnonzero(v == np.repeat(least, lengths))
            hit = hit[np.searchsorted(hit, starts)]
            place.append(hit)
            v[hit] = _TOP
        a, b = np.minimum(*place), np.maximum(*place)
        out[:, k] = words.mix(labels[a] * _U(0x9E3779B97F4A7C15) + words.mix(labels[b]))
    return out


def _signatures(size: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words.chunks(batch.column("text")):
                (labels, _), offsets, h = labelled_shingles(chunk, size)
                n_words = np.diff(chunk.doc_words)
                keys = [pa.array(words.text_key(x, chunk.doc_words, key).view(np.int64), mask=n_words == 0) for key, x in enumerate(h)]
                del h
                sketches = order_sketches(labels, offsets, bands * rows)
                band = np.zeros((len(sketches), bands), dtype=np.uint64)
                for r in range(rows):
                    band = words.mix(band + sketches[:, r::rows]) + _U(1)
                band = words.mix(band ^ np.arange(bands, dtype=np.uint64))
                counts = np.where(np.diff(offsets) > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(words.prefix(counts).astype(np.int32)), pa.array(band.view(np.int64).ravel()))
                part = slice(chunk.first, chunk.first + len(chunk))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], *keys, pa.array(np.diff(offsets)), lists], schema=schema)

    return run


def chain_length(at: np.ndarray) -> int:
    """Length of the longest increasing subsequence of distinct places."""
    if len(at) < 2 or (np.diff(at) > 0).all():
        return len(at)
    ends = np.empty(len(at), dtype=at.dtype)
    n = 0
    for x in at:
        i = int(np.searchsorted(ends[:n], x))
        ends[i] = x
        n = max(n, i + 1)
    return n


def aligned_similarity(first: list[np.ndarray], other: list[np.ndarray], threshold: float) -> float:
    """Common labelled shingles, equal in both hashes, in one order, over the union; 0 where it can't reach the threshold."""
    a, b = first[0], other[0]
    need = threshold * (len(a) + len(b)) / (1 + threshold)
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    labels, second = np.concatenate([a, b]), np.concatenate([first[1], other[1]])
    order = np.lexsort((second, labels))  # each label once a document, a's before b's
    labels, second = labels[order], second[order]
    both = np.flatnonzero((labels[1:] == labels[:-1]) & (second[1:] == second[:-1]))
    ia, ib = order[both], order[both + 1] - len(a)
    if len(ia) < need - 1e-9:
        return 0.0
    band = len(a) + len(b) - 2 * need + 1e-9
    near = np.abs(ia - ib) <= band
    ia, ib = ia[near], ib[near]
    m = chain_length(ib[np.argsort(ia)])
    return m / (len(a) + len(b) - m)


def _label_arrays(column: pa.Array, size: int) -> list[list[np.ndarray]]:
    """Both hashes of each text's labelled shingles."""
    out = []
    for chunk in words.chunks(column):
        labels, offsets, _ = labelled_shingles(chunk, size)
        out += [[x[a:b] for x in labels] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def _verify(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(_label_arrays(batch.column("text_a"), size), _label_arrays(batch.column("text_b"), size), strict=True)
            s = np.array([aligned_similarity(a, b, threshold) for a, b in pairs])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return run


SMALL = 32  #: members of a bucket whose open pairs are listed; larger buckets are compared in tiles
TILE_ROWS, TILE_SHINGLES = 256, 400_000
RARE = 12  #: documents of a tile up to which the pairs that share a shingle are counted one by one


def _shared(labels: list[np.ndarray]) -> np.ndarray:
    """For each pair of documents the number of labelled shingles that they share."""
    n = len(labels)
    doc = np.repeat(np.arange(n), [len(x) for x in labels])
    _, column, counts = np.unique(np.concatenate(labels), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    often = counts[column] > RARE
    out = np.zeros(n * n, dtype=np.float32)
    names = np.unique(column[often])
    place, at = np.searchsorted(names, column[often]), doc[often]
    for a in range(0, len(names), 2048):
        part = (place >= a) & (place < a + 2048)
        m = np.zeros((n, min(2048, len(names) - a)), dtype=np.float32)
        m[at[part], place[part] - a] = 1
        out += (m @ m.T).ravel()
    column, doc = column[~often], doc[~often]
    for step in range(1, min(RARE, len(column))):
        same = np.flatnonzero(column[step:] == column[:-step])
        out += np.bincount(doc[same] * n + doc[same + step], minlength=n * n).astype(np.float32)
    out = out.reshape(n, n)
    return np.maximum(out, out.T)


def _tile_links(reps: list[int], classes: list[int], blocks: list[int], labels: list[list[np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Enough links between documents of different classes (and, if there are two, of different blocks) to join all that are linked."""
    sizes = np.array([len(x[0]) for x in labels], dtype=np.float64)
    block, group = np.array(blocks), np.array(classes)
    good = _shared([x[0] for x in labels]) >= threshold * (sizes[:, None] + sizes) / (1 + threshold) - 1e-6
    good &= group[:, None] != group
    if len(set(blocks)) > 1:
        good &= block[:, None] != block
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(np.triu(good, 1)), strict=True):
        a, b = find(classes[i]), find(classes[j])
        if a != b and aligned_similarity(labels[i], labels[j], threshold) >= threshold:
            root[max(a, b)] = min(a, b)
            links.append((reps[i], reps[j]))
    return links


def _cross(size: int, threshold: float):
    """Rows of tiles in order -> links between their documents of different classes."""

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        reps, classes, blocks, texts = zip(*rows, strict=True)
        links = _tile_links(reps, classes, blocks, _label_arrays(pa.array(texts, pa.string()), size), threshold) if len(set(classes)) > 1 else []
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "low", "high", "rep", "class", "block", "text")]
            for key, low, high, *row in zip(*columns, strict=True):
                if (key, low, high) != tile:
                    if rows:
                        yield compared(rows)
                    tile, rows = (key, low, high), []
                rows.append(tuple(row))
        if rows:
            yield compared(rows)

    return run


def near_duplicates(docs: DataFrame, *, size: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 2) -> DataFrame:
    """One row a document of (doc_id, text): doc_id, class_id (the smallest doc_id that links lead to), kept (it is that one).

    Texts with the same words are copies whatever the white space.  A text without words, or null, is like no other; one
    of fewer words than a shingle has copies only.  Rows that share a doc_id count as one document; a null doc_id has a
    null class_id and is kept.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_signatures(size, bands, rows), "doc_id long, k1 long, k2 long, n long, bands array<long>"), "signatures")
    copies = signed.where("doc_id IS NOT NULL AND k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    every = stored(copies.select("rep", "n", F.explode("bands").alias("key")), "buckets")
    shared_keys = every.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min_by(F.struct("rep", "n"), "rep").alias("pivot")).where("members > 1")
    buckets = stored(every.join(shared_keys.hint("merge"), "key"), "buckets")
    dropped(every)
    texts = stored(docs.join(buckets.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    alike = lambda n, other: F.least(n, other) >= threshold * F.greatest(n, other)

    members = buckets.where((F.col("rep") != F.col("pivot.rep")) & alike(F.col("n"), F.col("pivot.n")))
    first = _aligned(members.select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b")).distinct(), texts, size, threshold)

    placed = buckets.join(components(first).toDF("rep", "class").hint("merge"), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    mixed = placed.groupBy("key").agg((F.min("class") != F.max("class")).alias("open")).where("open").select("key")
    undecided = stored(placed.join(mixed.hint("merge"), "key"), "undecided")
    listed = undecided.where((F.col("members") <= SMALL) & (F.col("rep") != F.col("pivot.rep"))).select("key", "rep", "n", "class")
    other = listed.toDF("key", "other_rep", "other_n", "other_class")
    pairs = listed.join(other, (listed["key"] == other["key"]) & (F.col("rep") < F.col("other_rep")) & (F.col("class") != F.col("other_class")) & alike(F.col("n"), F.col("other_n")))
    second = _aligned(pairs.select(F.col("rep").alias("a"), F.col("other_rep").alias("b")).distinct(), texts, size, threshold)
    third = _tiled(undecided.where(F.col("members") > SMALL), texts, size, threshold)
    dropped(buckets, texts, undecided)

    classes = components(first.union(second).union(third)).toDF("rep", "class")
    dropped(first, second, third)
    rep = copies.select("k1", "k2", "rep").join(classes, "rep", "left").select("k1", "k2", F.coalesce("class", "rep").alias("class"))
    out = signed.select("doc_id", "k1", "k2").join(rep, ["k1", "k2"], "left")
    class_id = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class", "doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def _aligned(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that alignment confirms."""
    first, second = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    joined = pairs.join(second.hint("merge"), "b").join(first.hint("merge"), "a")
    return stored(joined.mapInArrow(_verify(size, threshold), "a long, b long, similarity double").where(F.col("similarity") >= threshold).select("a", "b"), "links")


def _tiled(members: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links between members of large buckets that are in different classes: blocks of a bucket against each other, whole and in bounded pieces."""
    blocks = F.greatest(F.ceil(F.col("members") / TILE_ROWS), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    dealt = members.select("key", "rep", "class", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    with_text = dealt.join(texts.toDF("rep", "text").hint("merge"), "rep")
    paired = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = paired.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "class", "block", "text")
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(tiles.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_cross(size, threshold), "a long, b long"), "links")


def deduplicated_documents(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that are near-duplicates of one with a smaller doc_id in their class, all columns as they are.

    Of rows that share a doc_id and have the same words one stays.  Rows without a doc_id all stay, as do null texts and
    those without words; no rows give none.
    """
    gone = near_duplicates(docs, **options).where("NOT kept").select("doc_id").distinct()
    names = docs.columns
    plain = docs.toDF(*[f"given_{i}" for i in range(len(names))])
    given_id, given_text = (F.col(f"given_{names.index(c)}") for c in ("doc_id", "text"))
    left = plain.join(gone, given_id == F.col("doc_id"), "left_anti")
    repeated = stored(plain.where(given_id.isNotNull()).groupBy(given_id.alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        same = F.sha2(F.regexp_replace(F.coalesce(given_text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
        many = left.join(repeated, given_id == F.col("doc_id"), "left_semi").groupBy(given_id, same).agg(F.min_by(F.struct("*"), F.xxhash64(given_text)).alias("row")).select("row.*")
        left = left.join(repeated, given_id == F.col("doc_id"), "left_anti").unionByName(many)
    return left.toDF(*names)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
