"""Collocations against brute force, whatever the sizes of rows, slices and rounds."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import collocations as module


def brute_force(rows, least, top):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    per_lang = collections.defaultdict(list)
    for text, lang in rows:
        per_lang[lang or "und"] += [[w for w in re.split("[ \t]+", p) if w] for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low))]
    out = []
    for lang, pieces in per_lang.items():
        f = collections.Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, 6) for i in range(len(p) - k + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        often = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        held = {g for g in often for q in often if len(q) > len(g) and often[q] >= often[g] and any(q[i : i + len(g)] == g for i in range(len(q) - len(g) + 1))}
        scored = []
        for g, a in often.items():
            if g not in held:
                score, _, l, r = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed, n=160):
    rng = random.Random(seed)
    passages = [[f"P{k}{rng.randrange(9)}" for _ in range(9)] for k in range(3)]
    rows = []
    for i in range(n):
        words = [rng.choice(["the", "Of", "a", "é", "und"] + [f"w{rng.randrange(25)}"]) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)[rng.randrange(3) : rng.randrange(5, 10)]
        rows.append(("".join(w + rng.choice([" "] * 40 + ["  ", "\t", ". ", ",", "\n", " ? "]) for w in words), rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" ., ", "de"), ("one", "xx")] + rows[:5]


@pytest.mark.parametrize(("top", "most_grown", "row_words"), [(2000, 1 << 30, 1 << 20), (7, 1, 200), (40, 60, 500)])
def test_brute_force(spark, monkeypatch, top, most_grown, row_words):
    rows = texts(top)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3, "text").withColumns({c: F.lit("clash") for c in ("n", "p", "k", "word", "id", "a", "score", "rank")})
    got = module.collocations(docs, least=6, top=top, most_grown=most_grown, row_words=row_words, bucket_words=1 << 20 if top > 7 else 5).collect()
    expected = brute_force(rows, 6, top)
    assert sorted(tuple(r) for r in got) == expected
    assert len(expected) > 10 and any(len(r[2].split()) == 5 for r in expected)


def test_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert module.collocations(docs).collect() == []
    assert module.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).collect() == []


def decoded(row):
    vocab = row["vocab"].to_pylist()
    return [vocab[c - 1] if c else None for blob in row["codes"] for c in np.frombuffer(blob, np.uint32)]


def test_long_texts_in_pieces(monkeypatch):
    """One text of many pieces, with and without breaks, gives the numbers that it gives as one piece; cuts of rows lie at breaks."""
    text = " ".join(f"w{i % 1009}" + ("." if i % 37 == 0 else "") for i in range(30_000)) + "x" * 9000 + " end"
    column = pa.array([text, "Next one", None, "last."])
    whole = module._Coder()
    whole.add(column)
    expected = decoded(whole.row("en"))
    monkeypatch.setattr(module, "PIECE", 1000)
    monkeypatch.setattr(module, "BLOCK", 500)
    pieces = module._Coder()
    pieces.add(column)
    row = pieces.row("en")
    assert decoded(row) == expected and row["n"] == 30_004
    assert len(row["codes"]) > 40 and all(not blob or np.frombuffer(blob, np.uint32)[0] == 0 for blob in row["codes"])


def test_numbers_of_blocks(monkeypatch):
    """A row's blocks become numbers one by one; what is infrequent or alone among breaks is 0, and there are no two zeros in a row."""
    monkeypatch.setattr(module, "BLOCK", 4)
    coder = module._Coder()
    coder.add(pa.array(["a b. c d x a b, x a. a b c d", "d"]))
    row = coder.row("en")
    vocab = row["vocab"].to_pylist()
    number = lambda values: np.array(values, np.uint32).tobytes()
    own, ids = ([[number([f(w)]) for w in "abcd"]] * len(row["codes"]) for f in (vocab.index, lambda w: 10 * ("abcd".index(w) + 1)))
    batch = pa.RecordBatch.from_arrays([pa.array(row["codes"], pa.binary()), pa.array(own, pa.list_(pa.binary())), pa.array(ids, pa.list_(pa.binary()))], names=["codes", "own", "ids"])
    blocks = [np.frombuffer(b.column("ids")[0].as_py(), np.uint32).tolist() for b in module._numbered(iter([batch]))]
    assert len(blocks) > 2 and all(b[0] == 0 == b[-1] for b in blocks)
    runs = [r.split() for b in blocks for r in " ".join(map(str, b)).split(" 0") if r.strip(" 0")]
    assert [[int(x) for x in r if x != "0"] for r in runs] == [[10, 20], [30, 40], [10, 20], [10, 20, 30, 40]]


def test_slices_lose_no_phrase(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([[0], rng.integers(0, 4, 3000), [0]]).astype(np.uint32)
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes(), x[:1].tobytes()], pa.binary())], names=["ids"])

    def counts():
        total = collections.Counter()
        for b in module._count_pairs(iter([batch])):
            for r in b.to_pylist():
                total[r["k1"]] += r["n"]
        return total

    whole = counts()
    assert whole == collections.Counter(int(a) << 32 | int(b) for a, b in zip(x, x[1:], strict=False) if a and b)
    monkeypatch.setattr(module, "SLICE", 64)
    assert counts() == whole


def test_bitset_has_its_keys(spark, monkeypatch):
    monkeypatch.setattr(module, "SECTION", 12)
    monkeypatch.setattr(module, "LEAST_BITS", 14)
    keys = [(7 * i + (1 << 40), 0 if i % 2 else i << 33) for i in range(300)]
    bits = module._bitset(spark.createDataFrame(keys, "k1 long, k2 long"), 300).value
    k1, k2 = (np.array(c, dtype=np.uint64) for c in zip(*keys, strict=True))
    assert bits.has(k1[1::2]).all() and bits.has(k1[::2][1:], k2[::2][1:]).all()
    assert bits.has(np.arange(5000, dtype=np.uint64)).mean() < 0.2
