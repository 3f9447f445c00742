"""Unlike words never pass for one, whatever one of their two hashes says."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import decontamination, language_id, near_dedup, substring_dedup, suffix_tree_lm, words

#: Pairs of words that one 64-bit hash of an earlier build took for one.
PAIRS = [
    ("hwthebggdaadaaad", "mgrpkryiztjyjjjx"), ("hwthebggaadadaad", "hbihupfnojyizeux"), ("rxcdzovmaaaaaaaa", "sqdlkwtlvpooefpi"), ("tbrmjsxraaabaaaa", "tpdekewxnigcanch"),
    ("xfspprdwaaaaedaa", "batlclcqxtlqzyxo"), ("ifcmlvodabaaaaaa", "qcgqcnbpkxbosfrw"), ("xeplslhhaeaaaaaa", "jznodcdbiztlbcqw"), ("sevenby", "éother1"),
]


def text(side, repeats=8):
    return " ".join(p[side] for _ in range(repeats) for p in PAIRS)


def judged(spark):
    docs = spark.createDataFrame([(1, text(0)), (2, text(1)), (3, text(0))], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    classes = {r.doc_id: (r.class_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    kept = {r.doc_id for r in near_dedup.deduplicated_documents(docs).collect()}
    known = {r.doc_id: r.n_known for r in suffix_tree_lm.score_texts(docs, F.col("doc_id") != 2).collect()}
    items = spark.createDataFrame([(9, text(0, 2))], "item_id long, text string")
    held = sorted(r.doc_id for r in decontamination.contaminated_pairs(docs, items).collect())
    return removed, classes, kept, known, held


EXPECTED = ({1: 0, 2: 0, 3: 64}, {1: (1, True), 2: (2, True), 3: (1, False)}, {1, 2}, {1: 65, 2: 1, 3: 65}, [1, 3])


def test_pairs(spark):
    assert judged(spark) == EXPECTED


def test_first_hash_alone_decides_nothing():
    """With a first hash that is the same for all words of one length, shingles align, words count and items match by the second."""
    real = words.hash_words

    def weak(data, starts, ends, keys=(0,)):
        out = real(data, starts, ends, keys)
        return [np.asarray(ends - starts).astype(np.uint64) if k == 0 else h for k, h in zip(keys, out, strict=True)]

    one, other = " ".join(f"a{i:03}" for i in range(80)), " ".join(f"b{i:03}" for i in range(80))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(words, "hash_words", weak)
        a, b, again = near_dedup._label_arrays(pa.array([one, other, one]), 5)
        assert near_dedup.aligned_similarity(a, b, 0.8) == 0 and near_dedup.aligned_similarity(a, again, 0.8) == 1
        (h1, h2), offsets = suffix_tree_lm.sequences(pa.array([one, other, one]))
        first, _, which = words.distinct_pairs(h1, h2)
        assert len(first) == 161 and (which[:81] == which[162:]).all() and len(set(which[:81]) & set(which[81:162])) == 1
        indexes = decontamination.build_indexes([(9, one)], 0.6)
        found = [m for c in words.chunks(pa.array([other, one])) for m in decontamination._matches(indexes, c, 0.8)]
        assert [(d, i, q, r) for d, i, _, q, r in found] == [(1, 9, 1.0, 1.0)]


def test_distinct_pairs():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 60):
        a, b = rng.integers(0, most, 500).astype(np.uint64), rng.integers(0, 4, 500).astype(np.uint64)
        x, y, which = words.distinct_pairs(a, b)
        assert [*zip(x.tolist(), y.tolist(), strict=True)] == sorted(set(zip(a.tolist(), b.tolist(), strict=True)))
        assert (x[which] == a).all() and (y[which] == b).all()
    none = np.zeros(0, np.uint64)
    assert [len(v) for v in words.distinct_pairs(none, none)] == [0, 0, 0]


def test_hashes():
    """Words of all lengths around the lanes are unlike in both hashes; equal ones alike wherever they stand."""
    texts = [b"x" * n + bytes([c]) + b"y" * m for n in (0, 1, 7, 8, 15, 60, 64, 70) for c in b"abc" for m in (0, 1, 6, 7, 8, 56)]
    data = np.frombuffer(b" ".join(texts) + b" " + b" ".join(texts), np.uint8)
    chunk = next(words.chunks(pa.array([data.tobytes().decode()])))
    for h in chunk.both_hashes():
        assert (h[: len(texts)] == h[len(texts) :]).all() and len(np.unique(h)) == len(set(texts))


def test_subwords_by_pieces(monkeypatch):
    """The grams and sums of texts don't depend on the pieces that the bytes are taken in."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé \n") for _ in range(rng.randrange(40))) for _ in range(60)] + ["", "a", None, "long " * 500]
    table = np.random.default_rng(0).normal(size=(1 << language_id.BUCKET_BITS, 3))
    (chunk,) = words.chunks(pa.array(texts))
    grams = lambda: sorted(g for at, bucket in language_id._subwords(chunk) for g in zip(at.tolist(), bucket.tolist(), strict=True))
    whole, (sums, counts) = grams(), language_id._sums(chunk, table)
    assert len(whole) == sum(max(0, n - g + 1) for n in np.diff(chunk.doc_bytes) for g in language_id.GRAMS) == counts.sum()
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert grams() == whole
        again = language_id._sums(chunk, table)
        assert np.allclose(again[0], sums) and (again[1] == counts).all()
