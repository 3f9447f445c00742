"""Language identification by averaged subword embeddings.

A text is the mean of the embeddings of its hashed byte 2-, 3- and 4-grams, and a
linear softmax over that mean gives the languages.  Both layers are learned by
stochastic gradient descent in numpy on a sample of labelled documents with a
documented bound; a temperature fitted on a part of it kept aside calibrates the
probabilities, and so does the score under which a document is rejected.  As the
model is linear, prediction needs the embeddings' products with the softmax's
weights only: one row of a small table a subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import words

GRAMS = (2, 3, 4)
PIECE = 1 << 20  #: bytes whose subwords are looked up at a time
BUCKET_BITS = 16
UNKNOWN = "und"
_U = np.uint64


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  #: logits of each subword bucket
    bias: np.ndarray
    temperature: float
    least_score: float  #: below it a document is rejected

    def scores(self, column) -> tuple[np.ndarray, np.ndarray]:
        """For each text the most likely language's index and its probability."""
        n = len(column)
        logits = np.zeros((n, len(self.languages)))
        for chunk in words.chunks(column):
            sums, counts = _sums(chunk, self.table)
            logits[chunk.first : chunk.first + len(chunk)] = sums / np.maximum(counts, 1)[:, None]
        p = _softmax((logits + self.bias) / self.temperature)
        best = p.argmax(axis=1) if n else np.zeros(0, np.int64)
        return best, p[np.arange(n), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True)


def _subwords(chunk: words.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the grams inside documents and their buckets, by pieces of the bytes and by length; any white space is one kind of space."""
    n, more = len(chunk.data), max(GRAMS) - 1
    for a in range(0, n, PIECE):
        data = words.LOWER[chunk.data[a : a + PIECE + more]]  # with what the piece's last grams need
        data = np.where(words.SPACE[data], np.uint8(32), data).astype(np.uint64)
        count = min(PIECE, n - a)
        first, last = np.searchsorted(chunk.doc_bytes, (a, a + count), side="right")
        cuts = np.append(np.clip(chunk.doc_bytes[first:last] - a, 0, count), count)
        end = np.repeat(chunk.doc_bytes[np.minimum(np.arange(first, last + 1), len(chunk.doc_bytes) - 1)] - a, np.diff(cuts, prepend=0))
        value = data
        for size in range(1, max(GRAMS) + 1):
            if size > 1:
                value = (value[:-1] << _U(8)) | data[size - 1 :]
            if size in GRAMS:
                here = value[:count]
                inside = np.arange(len(here)) + size <= end[: len(here)]
                bucket = ((here[inside] + _U(size << 40)) * _U(0x9E3779B97F4A7C15)) >> _U(64 - BUCKET_BITS)
                yield np.flatnonzero(inside) + a, bucket.astype(np.uint16 if BUCKET_BITS <= 16 else np.uint32)


def _sums(chunk: words.Chunk, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(chunk)
    sums, counts = np.zeros((n, table.shape[1])), np.zeros(n, np.int64)
    for at, bucket in _subwords(chunk):
        cuts = np.searchsorted(at, chunk.doc_bytes)
        full = np.flatnonzero(np.diff(cuts))
        if len(full):
            sums[full] += np.add.reduceat(table[bucket], cuts[:-1][full], axis=0)
            counts[full] += np.diff(cuts)[full]
    return sums, counts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, lang, text) -> also the subword buckets of the text and their shares."""
    schema = pa.schema([("order", pa.int64()), ("lang", pa.string()), ("buckets", pa.binary()), ("shares", pa.binary())])
    for batch in batches:
        for chunk in words.chunks(batch.column("text")):
            rows: list[list[np.ndarray]] = [[] for _ in range(len(chunk))]
            for at, bucket in _subwords(chunk):
                cuts = np.searchsorted(at, chunk.doc_bytes)
                for i in range(len(chunk)):
                    rows[i].append(bucket[cuts[i] : cuts[i + 1]])
            out: dict[str, list] = {"buckets": [], "shares": []}
            for parts in rows:
                ids, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                out["buckets"].append(ids.astype(np.uint16 if BUCKET_BITS <= 16 else np.uint32).tobytes())
                out["shares"].append((n / max(1, n.sum())).astype(np.float32).tobytes())
            part = slice(chunk.first, chunk.first + len(chunk))
            yield pa.RecordBatch.from_pydict({"order": batch.column("order")[part], "lang": batch.column("lang")[part], **out}, schema=schema)


def fit(docs: DataFrame, *, usable: Column, most_documents: int = 4000, most_bytes: int = 64 << 20, dim: int = 16, epochs: int = 6, rate: float = 20.0, clean_loss: float = 0.001, floor: float = 0.5, seed: int = 7) -> LanguageModel | None:
    """A model of the usable rows of (doc_id, text, lang); None if there are none.

    Learns from about most_documents / languages documents of each language, chosen by a hash of doc_id and text, and from
    fewer where they have more than most_bytes of text together: that bounds what the driver gets.  A fifth of them calibrates: the temperature minimises the
    log loss, and the rejection score is the lowest clean_loss quantile of the right predictions, floor at most.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    counts = {r["lang"]: r["n"] for r in found}
    mean = {r["lang"]: r["bytes"] / r["n"] for r in found}
    if not counts:
        return None
    languages = sorted(counts)
    each = max(1, most_documents // len(languages))
    share = min(1.0, most_bytes / max(1.0, sum(min(each, n) * mean[name] for name, n in counts.items())))
    order = F.xxhash64("doc_id", "text", F.lit(seed))
    limit = F.lit(0)
    for name, n in counts.items():
        limit = F.when(F.col("lang") == name, F.lit(int(min(1.0, share * each / n) * ((1 << 31) - 1)))).otherwise(limit)
    sample = labelled.where(F.shiftrightunsigned(order, 33) <= limit).select(order.alias("order"), "lang", "text")
    rows = sorted(sample.mapInArrow(_features, "order long, lang string, buckets binary, shares binary").collect(), key=lambda r: (r["order"], r["lang"], r["buckets"]))
    data = [(np.frombuffer(r["buckets"], np.uint16).astype(np.int64), np.frombuffer(r["shares"], np.float32), languages.index(r["lang"])) for r in rows]
    aside = data[::5] if len(data) >= 50 else data
    train = [x for i, x in enumerate(data) if i % 5] if len(data) >= 50 else data

    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (1 << BUCKET_BITS, dim))
    weights, bias = rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            ids, share, y = train[i]
            lr = rate * (1 - done / steps)
            done += 1
            mean = share @ embeddings[ids]
            error = _softmax((mean @ weights + bias)[None])[0]
            error[y] -= 1
            back = weights @ error
            weights -= lr / 20 * np.outer(mean, error)
            bias -= lr / 2000 * error
            embeddings[ids] -= lr * np.outer(share, back)
    table = embeddings @ weights
    logits = np.array([share @ table[ids] + bias for ids, share, _ in aside])
    truth = np.array([y for *_, y in aside])
    at = np.arange(len(truth))
    temperature = min(np.geomspace(0.05, 20, 61), key=lambda t: -np.log(np.maximum(_softmax(logits / t)[at, truth], 1e-12)).mean())
    p = _softmax(logits / temperature)
    right = p[at, truth][p.argmax(axis=1) == truth]
    least = min(floor, float(np.quantile(right, clean_loss))) if len(right) else 0.0
    return LanguageModel(languages, table.astype(np.float32), bias, float(temperature), least)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang_pred, score and lang_accepted, from text alone; columns of docs with these names give way.

    Null texts and texts without a letter are und with score 0 and rejected, and all texts where nothing was learned.
    """
    docs = docs.drop("lang_pred", "score", "lang_accepted", "_letter")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"lang_pred": "string", "score": "double", "lang_accepted": "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            letter = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            if m is None:
                letter[:] = False
                best, score = np.zeros(len(letter), np.int64), np.zeros(len(letter))
            else:
                best, score = m.scores(batch.column("text"))
            names = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
            score = np.where(letter, score, 0.0)
            kept = letter & (score >= (m.least_score if m else 1))
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_letter"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score), pa.array(kept)], names=[*(n for n in batch.schema.names if n != "_letter"), *kinds])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{n} {k}" for n, k in kinds.items())])
    return docs.withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(divisor))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, usable=remainder(4) != 2)
    rows = identify(docs.select("doc_id", "text", (remainder(4) == 2).alias("held_out")), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "lang_accepted")


def accepted_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose language is accepted by a model learned from docs, as they are.

    Null texts and texts without a letter are not accepted; nothing is where no row has a text and lang to learn from.
    """
    model = fit(docs, usable=remainder(4) != 2, **options)
    columns = docs.columns
    renamed = docs.toDF(*[c if c == "text" else f"given_{i}" for i, c in enumerate(columns)])
    kept = identify(renamed, model).where("lang_accepted").drop("lang_pred", "score", "lang_accepted")
    return kept.toDF(*columns)
