"""The suffix tree against a tree of dictionaries, and on phrases that are a small share of the corpus."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from dossier.llm import suffix_tree_lm


def brute_force(texts, train, max_depth=3, least_count=3, penalty=3.0):
    """Scores by a tree of all contexts of the training texts."""
    places = [[(tuple(["<s>", *t][max(0, i + 1 - d) : i + 1]) if d <= i + 1 else None, x) for d in range(max_depth + 1)] for t in texts for i, x in enumerate([*t, None])]
    of = [k for k, t in enumerate(texts) for _ in range(len(t) + 1)]
    nexts = collections.defaultdict(collections.Counter)
    for k, row in zip(of, places):
        if train[k]:
            for c, x in row:
                if c is not None:
                    nexts[c][x] += 1
    root = nexts[()]
    n, v = sum(root.values()), len(root)
    total = {c: sum(x.values()) for c, x in nexts.items()}
    chance = lambda c, x: (root[x] + 0.1) / (n + 0.1 * (v + 1)) if not c else (nexts[c][x] + (len(nexts[c]) + 1) * chance(c[1:], x)) / (total[c] + len(nexts[c]) + 1)
    kept = {()}
    for c in sorted((c for c in total if c and total[c] >= least_count), key=len, reverse=True):
        if sum(k * math.log(k / total[c] / chance(c[1:], x)) for x, k in nexts[c].items()) >= penalty * math.log(max(2, n)):
            kept.update(c[i:] for i in range(len(c) + 1))
    out = [0.0] * len(texts)
    for k, row in zip(of, places):
        best = max((c for c, _ in row if c in kept), key=len)
        out[k] += math.log10(chance(best, row[0][1]))
    return out, kept


@pytest.mark.parametrize("hot", [1 << 20, 40])
def test_scores_against_brute_force(spark, hot):
    rng = random.Random(8)
    phrases = [[f"p{k}_{j}" for j in range(rng.randrange(3, 8))] for k in range(30)] + [[f"s{k}", "m", "k", f"r{k}"] for k in range(8)] * 4
    texts = []
    for _ in range(150):
        t = []
        for _ in range(rng.randrange(12)):
            t += rng.choice(phrases) if rng.random() < 0.4 else [f"w{min(rng.randrange(60), rng.randrange(60))}", rng.choice(["a", "b"]), rng.choice(["x", "y"])]
        texts.append(t)
    train = [i % 7 != 0 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree_lm.score_texts(docs, F.col("doc_id") % 7 != 0, group_bytes=4000, slice_entries=200, hot=hot).collect()}
    expected, kept = brute_force(texts, train)
    assert {len(c) for c in kept} == {0, 1, 2, 3}
    assert [got[i] for i in range(len(texts))] == pytest.approx(expected, rel=1e-9)
    assert brute_force(texts, train, least_count=1) == (expected, kept)


def test_phrases_that_are_a_small_share(spark):
    """A phrase seen nine times is learned however large the corpus is: here its words are under 1e-4 of the tokens."""
    rng = random.Random(9)
    texts = [" ".join(f"c{rng.randrange(900)}" for _ in range(500)) for _ in range(220)]
    for i in range(9):
        texts[i] += " one rare phrase"
    docs = spark.createDataFrame([*enumerate(texts), (1000, "one rare phrase"), (1001, "phrase one rare")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree_lm.score_texts(docs, F.col("doc_id") < 1000).where("doc_id >= 1000").collect()}
    assert got[1000].train_tokens > 1e5 and got[1000].base_score == pytest.approx(got[1001].base_score)
    assert got[1000].score > got[1000].base_score + 4 and got[1000].score > got[1001].score + 3
