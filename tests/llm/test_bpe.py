"""BPE against the tokenizers library."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
LETTERS = [chr(c) for c in [*range(0x250), 0x300, 0x301, 0x308, 0x327, 0x3A3, 0x3C2, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x130, 0x149, 0x1F600, 0x4E00, 0x1C89, 0xA7CB, 0x10D50, 0x10D40, 0x212B, 0xFB1D, 0x2028, 0x85, 0x1D15E, 0x1E9E]]
BITS = ["'s", "'re", "'ll", " ", "<|endoftext|>", "<|startoftext|>", "abc", "Σ", "'", "é", "12", "'LL", "!'s", "\n"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def parts():
    vocabulary = bpe.Vocabulary.read(PATH)
    return vocabulary, bpe.Cutter.make(vocabulary)


def odd_texts(seed, n, size=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) if rng.random() < 0.5 else rng.choice(BITS) for _ in range(rng.randrange(size))) for _ in range(n)]


def lexicon(vocabulary, words):
    return bpe.Lexicon.compiled((w, vocabulary.merged(w)) for w in sorted(set(words)))


@pytest.mark.parametrize("held", [0, 1, 3])
def test_odd_texts(library, parts, held):
    """Whatever share of the words the lexicon holds."""
    vocabulary, cutter = parts
    texts = odd_texts(held, 400)
    normal = [cutter.normal(t) for t in texts]
    data, starts, ends, _ = cutter.words("\n".join(normal))
    words = sorted({data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)} - {m.encode("utf-8", "surrogatepass") for m in cutter.special.values()})
    encoder = bpe._Encoder(vocabulary, cutter, lexicon(vocabulary, words[:: 4 - held] if held else []))
    ids, cuts = encoder.encode(normal)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_transducer():
    entries = [(b"a", (1,)), (b"ab", (1, 2)), (b"abc", (3,)), (b"bab", (9, 1, 2)), (b"xabc", (4, 5)), (b"xbbc", (4, 5)), (b"xz", (4,)), (b"yabc", (6, 5)), (b"ybbc", (6, 5)), (b"yz", (6,))]
    states = bpe.transducer(entries)
    by_word = {}

    def visit(state, word, ids):
        final, arcs = states[state]
        if final is not None:
            by_word[word] = ids + final
        for byte, target, out in arcs:
            visit(target, word + bytes([byte]), ids + out)

    visit(len(states) - 1, b"", ())
    assert by_word == dict(entries)
    assert len(set(map(str, states))) == len(states)
    tail = {t for b, t, _ in states[-1][1] if b in b"xy"}
    assert len(tail) == 1  # x and y go on alike
    built = bpe.Lexicon.compiled(entries)
    words = [w for w, _ in entries] + [b"", b"b", b"ac", b"abcd", b"zzz", b"xab"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    held, total, ids = built.walk(data, ends - [len(w) for w in words], ends)
    assert held.tolist() == [True] * len(entries) + [False] * 6
    assert total.tolist() == [len(o) for _, o in entries] + [0] * 6 and ids.tolist() == [i for _, o in entries for i in o]


def test_minimal(parts):
    """No two states of a lexicon of random words have the same final ids and arcs, and every word keeps its ids on the way through a file."""
    vocabulary, _ = parts
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8))).encode() for _ in range(3000)})
    entries = [(w, vocabulary.merged(w)) for w in words]
    states = bpe.transducer(entries)
    assert len({(f, tuple(arcs)) for f, arcs in states}) == len(states)


def test_long_words(library, parts):
    rng = random.Random(1)
    vocabulary, cutter = parts
    encoder = bpe._Encoder(vocabulary, cutter, lexicon(vocabulary, []))
    for size in (47, 48, 49, 50, 200, 20_000):
        word = "".join(rng.choice("theioanr") for _ in range(size))
        assert encoder.encode([word])[0].tolist() == library.encode(word, add_special_tokens=False).ids
        assert vocabulary._by_heap([vocabulary.first[b] for b in word.encode()]) == vocabulary._by_scan([vocabulary.first[b] for b in word.encode()]) if size < 300 else True


def test_documents(spark, library, monkeypatch):
    """All rows of the smallest table, odd texts, nulls, repeated rows, long texts in pieces and clashing columns."""
    documents = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] if os.path.isdir(SF) else []
    long_text = " ".join(odd_texts(9, 3000))
    rows = [*documents, (-1, None), (-2, ""), (None, "Null id's"), (-3, " \n\t"), (-4, "same"), (-4, "same"), (-5, long_text), (-6, "Ab1" * 30_000), *((-100 - i, t) for i, t in enumerate(odd_texts(8, 100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("ids", "n", "word", "n_tokens")})
    monkeypatch.setattr(bpe, "CHUNK", 5000)
    got = bpe.encoded(docs, PATH, most_words=300, with_ids=True).collect()
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest(), ids))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == sorted(expected)
    back = bpe.decoded(spark.createDataFrame([(r.doc_id, r.ids) for r in got] + [(7, None)], "doc_id long, ids array<int>"), PATH).collect()
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in back if r.text is not None) == sorted(r[3] for r in expected)
    assert [r.doc_id for r in back if r.text is None] == [7]


def test_pieces(parts, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 10)
    _, cutter = parts
    text = "Ab cd" * 20 + "é" * 100 + "7 end"
    assert "".join(cutter.pieces(text)) == cutter.normal(text)
    assert len([*cutter.pieces(text)]) > 5 and [*cutter.pieces("x" * 50)] == ["x" * 50]


def test_nothing(spark):
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
