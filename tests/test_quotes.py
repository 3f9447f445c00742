"""Quotes through an automaton against the search for each."""

import random

from pyspark.sql import functions as F

from dossier.operators import grounding


def test_against_search(spark, monkeypatch):
    rng = random.Random(2)
    words = ["ab", "abc", "b", "ünd", "ՀՀ", "c d", "a"]
    sources = [(k, " ".join(rng.choice(words) for _ in range(40)) if k % 9 else None) for k in range(30)]
    quotes = [(i, rng.choice([*range(33), None]), rng.choice(["  ", "", None, "ab\n\tabc", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(6))])) for i in range(600)]
    given = spark.createDataFrame(quotes, "id long, key long, quote string")
    table = spark.createDataFrame(sources, "key long, text string")
    plain = lambda s: " ".join((s or "").split())
    texts = dict(sources)
    expected = sorted((i, k is not None and plain(q) != "" and plain(q) in plain(texts.get(k))) for i, k, q in quotes)
    for most, few in ((10_000, 4), (3, 0)):
        monkeypatch.setattr(grounding, "MOST_QUOTES", most)
        monkeypatch.setattr(grounding, "FEW", few)
        assert sorted((r.id, r.grounded) for r in grounding.grounded(given, table, "key").collect()) == expected
    assert 100 < sum(g for _, g in expected) < 550
    where = {}
    for i, _, q in quotes:
        own = [k for k, t in sources if plain(q) and plain(q) in plain(t)]
        where[i] = (len(own), min(own, default=None))
    for most_bytes in (16 << 20, 40):
        got = grounding.found_sources(given, table, "id", "key", most_bytes=most_bytes).collect()
        assert {r.id: (r.n_sources, r.first_source) for r in got} == where


def test_a_source_moves_once(spark):
    """However many quotes a source has, the plan joins its text with one row."""
    quotes = spark.range(500).select("id", F.lit(1).cast("long").alias("key"), F.concat(F.lit("w"), "id").alias("quote"))
    sources = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(0, 500, 2)))], "key long, text string")
    got = grounding.grounded(quotes, sources, "key")
    assert {r.id: r.grounded for r in got.collect()} == {i: any(f"w{i}" in f"w{k}" for k in range(0, 500, 2)) for i in range(500)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner") < plan.index("Aggregate [")


def test_evidence(spark):
    results = spark.createDataFrame([(1, [("a", "x  y"), ("a", "z"), ("b", "x"), (None, "x")]), (2, []), (3, None), (4, [("c", "deep")])], "id long, evidence array<struct<source: string, text: string>>")
    sources = spark.createDataFrame([("a", "w x y"), ("c", "deep")], "source string, text string")
    assert {r.id: r.ungrounded for r in grounding.evidence_grounding(results, sources, "id").collect()} == {1: [1, 2, 3], 2: [], 3: [], 4: []}


def test_sources_are_read_once(spark, monkeypatch):
    """One pass over the sources whatever the quotes; windows and quotes of all lengths, over stretches of a few bytes."""
    from dossier.operators import lookup

    rng = random.Random(5)
    said = ["".join(rng.choice("aabé Հ\t") for _ in range(rng.randrange(120))) for _ in range(60)] + ["a" * 100, "ab" * 70, "", None]
    plain = lambda s: " ".join((s or "").split())
    quotes = [s[i : i + n] for s in said if s for n in (1, 2, 3, 5, 8, 9, 15, 16, 31, 33, 64, 90) for i in (0, 3, 20)] + ["a" * 99 + "b", "", None, "x"]
    given = spark.createDataFrame(list(enumerate(quotes)), "id long, quote string").repartition(3)
    table = spark.createDataFrame([(k if k else None, s) for k, s in enumerate(said)] + [(7, said[7])], "key long, text string")
    expected = {}
    for i, q in enumerate(quotes):
        own = [k for k, s in [*enumerate(said), (7, said[7])] if plain(q) and plain(q) in plain(s)]
        expected[i] = (len(own), min((k for k in own if k), default=None))
    for stretch, most_bytes in ((1 << 19, 64 << 20), (50, 64 << 20), (7, 100)):
        monkeypatch.setattr(lookup, "STRETCH", stretch)
        found = grounding.found_sources(given, table, "id", "key", most_bytes=most_bytes)
        assert {r.id: (r.n_sources, r.first_source) for r in found.collect()} == expected
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
