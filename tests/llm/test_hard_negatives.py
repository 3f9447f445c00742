"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import hard_negatives as module


def brute_force(rows):
    usable = [(i, math.inf if v is None else v, [math.floor(256 * c) for c in e], label) for i, (v, e, label) in enumerate(rows) if e is not None and label is not None and all(c is not None and math.isfinite(c) for c in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    plain = lambda v: None if v == math.inf else v
    out = []
    for i, v, q, label in usable:
        if v == math.inf or v % 50:
            continue
        scored = sorted(((-dot(q, o[2]), o[1], o[0], o[3]) for o in usable if o[0] != i), key=lambda s: s[:3])
        for p, p_id, _, _ in [s for s in scored if s[3] == label][:5]:
            fits = [s for s in scored if s[3] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(v, plain(p_id), k + 1, plain(s[1]), -p, -s[0]) for k, s in enumerate(fits)]
    return out


def table(seed, n, dim, spread, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((10 * i, [scale * float(np.float32(x + spread * rng.gauss(0, 1))) for x in c], rng.randrange(3)))
    rows += rows[:3] + [(50, None, 1), (100, [1.0] * dim, None), (None, rows[0][1], 0), (None, rows[1][1], 1), (150, [float("nan")] * dim, 1), (200, [None] * dim, 1), (250, [0.0] * dim, 1), (300, [], 2), (350, [-1.0] * dim, 0), (400, [float("inf")] * dim, 0)]
    rng.shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"
order = lambda rows: sorted(map(str, rows))


@pytest.mark.parametrize(("seed", "n", "dim", "spread", "scale", "block_bytes"), [(1, 300, 5, 0.1, 1.0, 4 << 20), (2, 300, 3, 1.0, 0.02, 200), (3, 200, 4, 0.3, 1e5, 4 << 20)])
def test_brute_force(spark, seed, n, dim, spread, scale, block_bytes):
    """Ties, repeated rows, null ids, windows below zero, blocks of a few anchors, and scores past what doubles hold."""
    rows = table(seed, n, dim, spread, scale)
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("row", "q", "x", "anchor", "score", "id")})
    got = module.hard_negatives(vectors, anchor=F.col("vec_id") % 50 == 0, block_bytes=block_bytes).collect()
    expected = brute_force(rows)
    assert order(tuple(r) for r in got) == order(expected) and len(expected) > 100


def test_few_are_rescored():
    """In tight clusters the bounds leave few rows of other clusters to rescore, and the chosen ones hold the best."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 32)) * 200
    anchors = np.floor(centres.repeat(20, axis=0) + rng.normal(size=(160, 32)))
    rows = np.floor(centres.repeat(100, axis=0) + rng.normal(size=(800, 32)))
    tree, nodes = module.Tree.of(anchors)
    assert sorted(nodes.tolist()) == [*range(160)] and (tree.parent[1:] >= 0).all() and (tree.parent < np.arange(160)).all()
    norms = np.sqrt((rows**2).sum(axis=1))
    chosen_n = 0
    for node, chosen, scores in tree.walk(rows, norms, lambda node, low, high: high >= module._kth(low, 5)):
        exact = rows @ tree.vectors[node]
        assert (scores == exact[chosen]).all()
        assert sorted(exact)[-5:] == sorted(exact[chosen])[-5:]
        chosen_n += len(chosen)
    assert chosen_n < 0.3 * len(rows) * len(anchors)


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 50, (60, 3)).astype(float)
    tree, _ = module.Tree.of(x)
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    group = list(range(60))
    total = 0.0
    for d, i, j in sorted((away[i, j], i, j) for i in range(60) for j in range(i)):
        if group[i] != group[j]:
            total += d
            group = [group[i] if g == group[j] else g for g in group]
    assert tree.edge[1:].sum() == pytest.approx(total)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert module.hard_negatives(none, anchor=F.col("vec_id") % 50 == 0).collect() == []
    no_anchor = spark.createDataFrame([(1, [1.0], 1), (None, [1.0], 2)], SCHEMA)
    assert module.hard_negatives(no_anchor, anchor=F.col("vec_id") % 50 == 0).collect() == []
    alone = spark.createDataFrame([(50, [1.0], 1), (2, [1.0], 2)], SCHEMA)
    assert module.hard_negatives(alone, anchor=F.col("vec_id") % 50 == 0).collect() == []
