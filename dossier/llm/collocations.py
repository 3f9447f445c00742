"""Phrase collocations by best-first branch-and-bound growth of prefixes.

A phrase's score is its lowest-scoring cut, 1000*a*n/(l*r).  The cut after the first
word has l = f(first word) and r >= a, so that no phrase that begins with a word w
scores above 1000*n/f(w): the count of the first word bounds all growth of a prefix.

1. One pass over the texts codes them: rows of some million words with a vocabulary
   of their own.  Counts of the words come from the vocabularies; words of fewer than
   `least` occurrences can be in no phrase and end a run, as the ends of pieces do.
   The others get whole numbers, so that phrases are compared by numbers, exactly.
2. All pairs are counted, combined in each task first.  A pair's score is known from
   here; the pairs with `least` occurrences are the frontier of prefixes.
3. The prefixes with the highest bounds grow to phrases of three to five words, a
   batch of the frontier at a time, until every prefix that is left is bounded below
   its language's top-th surviving score.  Counts of rests that no growth has met are
   asked for in a pass of their own, and only for phrases that could still enter.

A phrase is dropped if a longer candidate with no fewer occurrences holds it.  Then a
phrase one word longer does so too, which means that all its occurrences have the
same word on one side; the counts carry that along (the word, or 0).

Prefixes and requests reach the tasks as bitsets of bounded size: what they let
through for nothing is counted exactly like the rest, and nothing is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.scratch import dropped, stored
from dossier.llm.words import LOWER, mix, prefix

LONGEST = 5
PIECE = 2 << 20  #: bytes that are cut into words at a time
BLOCK = 1 << 20  #: numbers after which a row's texts are cut at the next break
SENT = 1 << 17  #: rows that a task hands on at a time
SLICE = 2 << 20  #: places whose phrases are counted at a time
LEAST_BITS, MOST_BITS, SECTION = 20, 28, 20  #: powers of two: bits of a bitset, and of what one task makes of it
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_U = np.uint64

CODED = "row string, lang string, n long, vocab array<string>, counts array<int>, codes array<binary>"
COUNTED = "k1 long, k2 long, k3 long, n long, sides long"


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of a column in pieces that end behind a separator or a text, with the places in each where texts begin."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + PIECE)
        while stop < end:
            text = int(offsets[np.searchsorted(offsets, stop)])
            ahead = np.flatnonzero(_CLASS[data[stop : min(text, stop + 4096)]])
            stop = stop + int(ahead[0]) + 1 if len(ahead) else min(text, stop + 4096)
            if len(ahead) or stop == text:
                break
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)]
        yield data[at:stop], np.unique(inside[inside < end] - at)
        at = stop


class _Coder:
    """Words of one language as numbers of a vocabulary, in the order of the texts; 0 parts pieces.  A row begins with a 0."""

    def __init__(self) -> None:
        self.vocab: list[pa.Array] = []
        self.codes: list[np.ndarray] = []
        self.words = 0
        self.broken = True

    def add(self, column: pa.Array) -> None:
        for data, begins in _texts(column):
            kind = _CLASS[data]
            word = kind == 0
            before = np.zeros(len(data), dtype=bool)
            before[1:] = word[:-1]
            before[begins] = False
            starts = np.flatnonzero(word & ~before)
            after = np.zeros(len(data), dtype=bool)
            after[:-1] = word[1:]
            after[begins[begins > 0] - 1] = False
            ends = np.flatnonzero(word & ~after) + 1
            breaks = (kind == 2).astype(np.int32)
            breaks[begins] += 1
            breaks = np.cumsum(breaks)
            if not len(starts):
                self.broken = self.broken or bool(len(data) and breaks[-1])
                continue
            at = breaks[starts]
            parted = np.empty(len(starts), dtype=bool)
            parted[0] = self.broken or at[0] > 0
            parted[1:] = at[1:] != at[:-1]
            self.broken = bool(breaks[-1] != at[-1])
            spelled = LOWER[data[word]]
            array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(prefix(ends - starts)), pa.py_buffer(spelled)]).dictionary_encode()
            out = np.zeros(len(starts) + int(parted.sum()), dtype=np.uint32)
            out[np.arange(len(starts)) + np.cumsum(parted)] = array.indices.to_numpy() + 1
            self.vocab.append(array.dictionary)
            self.codes.append(out)
            self.words += len(starts)

    def row(self, lang: str) -> dict:
        whole = pa.concat_arrays(self.vocab).dictionary_encode()
        numbers, first, codes = whole.indices.to_numpy().astype(np.uint32) + 1, 0, []
        for vocab, own in zip(self.vocab, self.codes, strict=True):
            codes.append(np.concatenate([np.zeros(1, np.uint32), numbers[first : first + len(vocab)]])[own])
            first += len(vocab)
        codes = np.concatenate(codes)
        breaks = np.flatnonzero(codes == 0)
        cuts = [0, *np.unique(breaks[np.minimum(np.searchsorted(breaks, np.arange(BLOCK, len(codes), BLOCK)), len(breaks) - 1)]).tolist(), len(codes)]
        counts = np.bincount(codes, minlength=len(whole.dictionary) + 1)[1:]
        return {"row": uuid.uuid4().hex, "lang": lang, "n": self.words, "vocab": whole.dictionary.cast(pa.large_string()), "counts": counts.astype(np.int32), "codes": [codes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]}


def _code(row_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.string()), ("lang", pa.string()), ("n", pa.int64()), ("vocab", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("codes", pa.list_(pa.binary()))])
        coders: dict[str, _Coder] = {}

        def ended(lang: str) -> pa.RecordBatch:
            row = coders.pop(lang).row(lang)
            as_list = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values).cast(kind))
            return pa.RecordBatch.from_arrays([pa.array([row["row"]]), pa.array([lang]), pa.array([row["n"]]), as_list(row["vocab"], pa.string()), as_list(row["counts"], pa.int32()), as_list(row["codes"], pa.binary())], schema=schema)

        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                texts = batch.column("text").filter(pc.equal(langs, lang))
                size = max(1, PIECE // max(1, texts.nbytes // max(1, len(texts))))
                for at in range(0, len(texts), size):
                    coder = coders.setdefault(lang, _Coder())
                    coder.broken = True
                    coder.add(texts.slice(at, size))
                    if coder.words >= row_words:
                        yield ended(lang)
        for lang in sorted(coders):
            if coders[lang].words:
                yield ended(lang)
        pa.default_memory_pool().release_unused()

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a row (codes, words) and the frequent ones (known, ids) of the same bucket -> the codes of those that are frequent, and their numbers."""
    for batch in batches:
        out: dict[str, list] = {"codes": [], "ids": []}
        for i in range(batch.num_rows):
            codes, words, known, ids = (batch.column(c)[i].values for c in ("codes", "words", "known", "ids"))
            at = pc.index_in(words, value_set=known)
            found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            out["codes"].append(codes.to_numpy()[found].astype(np.uint32).tobytes())
            out["ids"].append(ids.to_numpy()[at.fill_null(0).to_numpy()[found]].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out["codes"], pa.binary()), pa.array(out["ids"], pa.binary())], names=["row", "codes", "ids"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of a row's vocabulary -> numbers of frequent words (own and ids: codes and numbers in pieces); runs of what is no such word, and such words alone, are one 0."""
    for batch in batches:
        for i in range(batch.num_rows):
            codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint32)
            own, given = (np.frombuffer(b"".join(batch.column(c)[i].as_py()), np.uint32) for c in ("own", "ids"))
            ids = np.zeros(max(int(codes.max(initial=0)), int(own.max(initial=0)) + 1) + 1, dtype=np.uint32)
            ids[own.astype(np.int64) + 1] = given
            x = np.concatenate([np.zeros(1, np.uint32), ids[codes], np.zeros(1, np.uint32)])
            left, right = np.append(x[:1] * 0, x[:-1]), np.append(x[1:], x[:1] * 0)
            x[(left == 0) & (right == 0)] = 0
            x = x[(x > 0) | np.append(True, x[:-1] > 0)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["ids"])
    pa.default_memory_pool().release_unused()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Numbers of words of about SLICE places, with LONGEST zeros around them or what stands there."""
    edge = np.zeros(LONGEST, dtype=np.uint32)
    held, size = [edge], 0

    def cut() -> Iterator[np.ndarray]:
        x = np.concatenate([*held, edge])
        for at in range(LONGEST, len(x) - LONGEST, SLICE):
            yield x[at - LONGEST : min(len(x), at + SLICE + LONGEST)].astype(np.uint64)

    for batch in batches:
        for blob in batch.column("ids"):
            held.append(np.frombuffer(blob.as_py(), np.uint32))  # begins and ends with 0
            size += len(held[-1])
            if size >= SLICE:
                yield from cut()
                held, size = [edge], 0
    yield from cut()


def _combined(k1: np.ndarray, k2: np.ndarray | None, k3: np.ndarray | None, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Equal phrases as one row: how many, and the word on either side if it is the same for all."""
    keys = [k for k in (k1, k2, k3) if k is not None]
    order = np.argsort(k1, kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, left, right = [k[order] for k in keys], left[order], right[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    same = lambda side: np.where(np.minimum.reduceat(side, at) == np.maximum.reduceat(side, at), side[at], _U(0)) if len(at) else side[at]
    keys = [k[at] for k in keys] + [np.zeros(len(at), np.uint64)] * (3 - len(keys))
    sides = same(left) << _U(32) | same(right)
    columns = [*keys, np.diff(np.append(at, len(order))), sides]
    for a in range(0, len(at), SENT):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + SENT].astype(np.int64)) for c in columns], names=["k1", "k2", "k3", "n", "sides"])


def _pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the pair that begins there, and whether both of it are words."""
    a, b = x[:-1], x[1:]
    return a << _U(32) | b, (a > 0) & (b > 0)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _slices(batches):
        pair, word = _pairs(x)
        at = np.flatnonzero(word[LONGEST : len(x) - LONGEST]) + LONGEST
        yield from _combined(pair[at], None, None, x[at - 1], x[at + 2])


def _bit(k1: np.ndarray, k2: np.ndarray | None, bits: int) -> np.ndarray:
    h = mix(k1 + _U(0x9E3779B97F4A7C15))
    return ((mix(h + k2) if k2 is not None else h) & _U((1 << bits) - 1)).astype(np.int64)


class _Bits:
    """A set of keys as bits; has() may also be true of others."""

    def __init__(self, sections: dict[int, bytes], bits: int) -> None:
        self.bits = bits
        size = 1 << SECTION >> 3
        self.data = np.frombuffer(b"".join(sections.get(k, bytes(size)) for k in range(1 << bits >> SECTION)), np.uint8)

    def has(self, k1: np.ndarray, k2: np.ndarray | None = None) -> np.ndarray:
        at = _bit(k1, k2, self.bits)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _bitset(keys: DataFrame, n: int):
    """A broadcast of the keys (k1, and k2 where it isn't 0): up to 2**MOST_BITS bits, made in sections."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(16 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy().astype(np.uint64) for c in ("k1", "k2"))
            at = np.where(k2 > 0, _bit(k1, k2, bits), _bit(k1, None, bits))
            at = np.unique(at)
            section = at >> SECTION
            cuts = [*np.flatnonzero(np.append(True, section[1:] != section[:-1])[: len(at)]).tolist(), len(at)]
            own = [(int(section[a]), (at[a:b] & ((1 << SECTION) - 1)).astype(np.uint32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in own], pa.int64()), pa.array([b for _, b in own], pa.binary())], names=["section", "places"])

    def united(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << SECTION, dtype=bool)
        for blob in table.column("places"):
            out[np.frombuffer(blob.as_py(), np.uint32)] = True
        return pa.table({"section": table.column("section")[:1], "data": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    made = keys.select("k1", "k2").mapInArrow(places, "section long, places binary").groupBy("section").applyInArrow(united, "section long, data binary")
    return keys.sparkSession.sparkContext.broadcast(_Bits({r["section"]: bytes(r["data"]) for r in made.collect()}, bits))


def _grow(frontier, frequent):
    """Phrases of three to five words that begin with a pair of the frontier, all of whose pairs are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _slices(batches):
            pair, word = _pairs(x)
            at = np.flatnonzero(word[LONGEST : len(x) - LONGEST]) + LONGEST
            often = np.zeros(len(pair), dtype=bool)
            here = np.flatnonzero(word)
            often[here] = frequent.value.has(pair[here])
            at = at[often[at] & often[at + 1]]
            at = at[frontier.value.has(pair[at])]
            for k in range(3, LONGEST + 1):
                at = at[often[at + k - 2]]
                yield from _phrases(x, pair, at, k)

    return run


def _phrases(x: np.ndarray, pair: np.ndarray, at: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    return _combined(pair[at], x[at + 2] << _U(32) if k == 3 else pair[at + 2], x[at + 4] if k == 5 else None, x[at - 1], x[at + k])


def _asked(requests):
    """Phrases of three and four words that were asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _slices(batches):
            pair, word = _pairs(x)
            at = np.flatnonzero(word[LONGEST : len(x) - LONGEST]) + LONGEST
            for k in (3, 4):
                at = at[word[at + k - 2]]
                own = requests.value.has(pair[at], x[at + 2] << _U(32) if k == 3 else pair[at + 2])
                yield from _phrases(x, pair, at[own], k)

    return run


def _summed(counted: DataFrame, least: int, keys: tuple[str, ...] = ("k1", "k2", "k3")) -> DataFrame:
    """(p: numbers of the words, k1, k2, n, held: a longer candidate with as many occurrences holds it).

    All parts have the same word on a side if and only if the bits that all have are those that any has.
    """
    sums = counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_and("sides").alias("all_have"), F.bit_or("sides").alias("any_has")).where(F.col("n") >= least)
    sums = sums.withColumns({k: F.lit(0).cast("long") for k in ("k1", "k2", "k3") if k not in keys})
    first, second = (lambda c: F.shiftrightunsigned(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    p = F.filter(F.array(first("k1"), second("k1"), first("k2"), second("k2"), F.col("k3")), lambda v: v > 0)
    one_side = lambda half: (half("all_have") == half("any_has")) & (half("all_have") > 0)
    return sums.select(p.alias("p"), "k1", "k2", "n", ((F.size(p) < LONGEST) & (one_side(first) | one_side(second))).alias("held"))


def _best_cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Per candidate (p, lang, total, a, first_n, held): its lowest cut among those with known counts, and the rests without one.

    score is exact where unknown is empty, and otherwise no less than the candidate's.
    """
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    cuts = cuts.withColumns({"head": F.slice("p", F.lit(1), F.col("k")), "rest": F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))})
    cuts = cuts.join(counts.toDF("head", "l"), "head").join(counts.toDF("rest", "r"), "rest", "left")
    score = F.expr("CAST(1000 * CAST(a AS DECIMAL(19,0)) AS DECIMAL(19,0)) * CAST(total AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(coalesce(r, a) AS DECIMAL(19,0)))")
    cuts = cuts.withColumn("score", score)
    keys = ["p", "lang", "total", "a", "first_n", "held"]
    best = F.min(F.struct("score", "k", "l", "r"))
    found = cuts.groupBy(*keys).agg(best.alias("best"), F.collect_list(F.when(F.col("r").isNull(), F.col("rest"))).alias("unknown"))
    return found.select(*keys, "best.score", "best.l", "best.r", "unknown")


def _settled(scored: DataFrame, top: int) -> DataFrame:
    """Per language the top-th surviving score, where there are so many."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"))
    return scored.where("NOT held AND size(unknown) = 0").select("lang", "score").withColumn("place", F.row_number().over(order)).where(F.col("place") == top).select("lang", F.col("score").alias("settled"))


def collocations(docs: DataFrame, *, least: int = 100, top: int = 2000, row_words: int = 2 << 20, bucket_words: int = 20_000, most_grown: int = 1 << 30) -> DataFrame:
    """The best phrases of two to five words of (text, lang) per language: lang, rank, phrase, a, l, r, n, score.

    A null lang is 'und', a null or empty text has no words; rows that repeat count again; an empty table gives none.  A
    text may be of any length: it is cut into words in pieces, and its numbers are counted in slices.  Ties go by a, then by
    the phrase's bytes.  most_grown: occurrences of the prefixes that grow in one round; smaller rounds give the same rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    coded = stored(docs.mapInArrow(_code(row_words), CODED), "coded")
    totals = coded.groupBy("lang").agg(F.sum("n").alias("total"))
    seen = coded.select("lang", F.explode(F.arrays_zip("vocab", "counts")).alias("w")).groupBy("lang", F.col("w.vocab").alias("word")).agg(F.sum("w.counts").alias("n")).where(F.col("n") >= least)
    placed = stored(seen.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "words")
    starts, first = [], 1
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).orderBy("part").collect():  # a row for each shuffle partition
        starts.append((r["part"], first - r["at"]))
        first += r["n"]
    vocabulary = stored(placed.join(F.broadcast(spark.createDataFrame(starts, "part int, shift long")), "part").select("lang", "word", "n", (F.col("at") + F.col("shift")).alias("id")), "words")
    dropped(placed)
    buckets = F.lit(1 + (first - 1) // bucket_words)
    bucket = F.pmod(F.xxhash64("word"), buckets).alias("bucket")
    asked = coded.select("row", "lang", F.posexplode("vocab").alias("code", "word")).groupBy("row", "lang", bucket).agg(F.collect_list("code").alias("codes"), F.collect_list("word").alias("words"))
    told = vocabulary.groupBy("lang", bucket).agg(F.collect_list("word").alias("known"), F.collect_list("id").alias("ids"))
    answers = asked.join(told, ["lang", "bucket"]).select("row", "codes", "words", "known", "ids").mapInArrow(_looked_up, "row string, codes binary, ids binary")
    known = answers.groupBy("row").agg(F.collect_list("codes").alias("own"), F.collect_list("ids").alias("ids"))
    texts = stored(coded.select("row", F.explode("codes").alias("codes")).join(known, "row").select("codes", "own", "ids").mapInArrow(_numbered, "ids binary"), "numbers")
    names = vocabulary.join(stored(totals, "totals"), "lang").select("id", "lang", "word", F.col("n").alias("word_n"), "total")
    dropped(coded)

    pairs = stored(_summed(texts.mapInArrow(_count_pairs, COUNTED), least, ("k1",)), "pairs")
    of_words = vocabulary.select(F.array("id").alias("p"), "n")
    first_words = names.select("id", "lang", "total", F.col("word_n").alias("first_n"))

    def candidates(found: DataFrame) -> DataFrame:
        return found.select("p", F.col("n").alias("a"), "held", F.col("p")[0].alias("id")).join(first_words, "id").drop("id")

    counts = of_words.union(pairs.select("p", "n"))
    scored = stored(_best_cuts(candidates(pairs), counts), "scored")
    settled = stored(_settled(scored, top), "settled")
    bound = F.expr("1000 * total div first_n")
    frontier = candidates(pairs).select("p", "lang", "a", bound.alias("bound"), ((F.col("p")[0] * F.lit(1 << 32)).bitwiseOR(F.col("p")[1])).alias("k1"), F.lit(0).cast("long").alias("k2"))
    frontier = stored(frontier.withColumn("level", F.floor(F.log2(F.col("bound") + 1)).cast("int")), "frontier")
    n_pairs = pairs.count()
    frequent = _bitset(pairs.select("k1", "k2"), n_pairs)
    above = 1 << 30  # levels from here on have grown
    while n_pairs:
        open_prefixes = frontier.where(F.col("level") < above).join(settled, "lang", "left").where("settled IS NULL OR bound >= settled")
        levels = open_prefixes.groupBy("level").agg(F.sum("a").alias("a"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()  # 64 rows at most
        if not levels:
            break
        grown_n = n_keys = 0
        for r in levels:
            if grown_n and grown_n + r["a"] > most_grown:
                break
            grown_n, n_keys, down_to = grown_n + r["a"], n_keys + r["n"], r["level"]
        batch = _bitset(open_prefixes.where(F.col("level") >= down_to).select("k1", "k2"), n_keys)
        above = down_to
        grown = stored(_summed(texts.mapInArrow(_grow(batch, frequent), COUNTED), least), "grown")
        batch.unpersist()
        new = grown.join(scored.select("p"), "p", "left_anti")
        counts = counts.union(new.select("p", "n")).dropDuplicates(["p"])
        fresh = stored(_best_cuts(candidates(new), counts), "scored")
        asked = _open(scored.union(fresh), settled, top).select(F.explode("unknown").alias("p")).distinct()
        word = lambda i: F.coalesce(F.try_element_at("p", F.lit(i)), F.lit(0))
        asked = stored(asked.select("p", (word(1) * F.lit(1 << 32)).bitwiseOR(word(2)).alias("k1"), (word(3) * F.lit(1 << 32)).bitwiseOR(word(4)).alias("k2")), "asked")
        n_asked = asked.count()
        if n_asked:
            requests = _bitset(asked, n_asked)
            told = stored(_summed(texts.mapInArrow(_asked(requests), COUNTED), least).join(asked.select("p"), "p", "left_semi"), "told")
            requests.unpersist()
            counts = counts.union(told.select("p", "n")).dropDuplicates(["p"])
            both = scored.union(fresh)
            again = _best_cuts(both.where("size(unknown) > 0").select("p", "a", "held", "lang", "total", "first_n"), counts)
            scored = stored(both.where("size(unknown) = 0").union(again.select(both.columns)), "scored")
        else:
            scored = stored(scored.union(fresh), "scored")
        settled = stored(_settled(scored, top), "settled")
    frequent.unpersist()

    final = scored.where("NOT held AND size(unknown) = 0").withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score")))).where(F.col("place") <= top)
    spelled = final.select("p", F.posexplode("p").alias("at", "id")).join(names.select("id", "word"), "id").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    final = final.join(spelled.select("p", F.array_join(F.col("words.word"), " ").alias("phrase")), "p")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return final.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _open(scored: DataFrame, settled: DataFrame, top: int) -> DataFrame:
    """The surviving candidates that lack a count and could still be among the top."""
    return scored.where("NOT held AND size(unknown) > 0").join(settled, "lang", "left").where("settled IS NULL OR score >= settled")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score
  FROM candidates c, range(1, 5) t(j), f l, f r, totals
  WHERE j < c.k AND l.lang = c.lang AND r.lang = c.lang AND totals.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (
  SELECT 1 FROM candidates c WHERE c.lang = b.lang AND len(c.phrase) > len(b.phrase) AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
