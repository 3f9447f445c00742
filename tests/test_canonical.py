"""Canonical texts against Python's own."""

import hashlib
import json
import math
import random
import unicodedata

from pyspark.sql import functions as F

from dossier.functions import canonical, text
from dossier.operators import contexts
from dossier.sources import probes


def test_floats(spark):
    rng = random.Random(1)
    numbers = [0.0, -0.0, 1.0, 0.1, 1e-4, 1e-5, 9.999e-5, 1e15, 1e16, 1.5e16, 123456789.125, 1e7, 1e-3, 1e22, 1e23, -2.5e-10, 100.0, 1e100, 1.7976931348623157e308, 2.0**-44, math.nan, math.inf, -math.inf]
    numbers += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-20, 25) for _ in range(3000)] + [round(rng.uniform(-1000, 1000), rng.randrange(6)) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", canonical.float_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in rows if r.t != json.dumps(r.x)] == []


SCHEMA = "id long, z struct<b: array<map<string, double>>, a: struct<`É`: string, `E`: boolean>>, `a b` array<array<int>>, m map<string, array<string>>, d date, n decimal(10,2), t string"


def test_nested(spark):
    import datetime
    from decimal import Decimal

    odd = ["", "q\"\\/\b\f\n\r\t\x00\x1f\x7f é🙂", "\\u000B", None, "plain", "�\U00010000"]
    rng = random.Random(2)
    rows = []
    for k in range(40):
        pick = lambda: rng.choice(odd)
        deep = {"b": [{"y": 1.5, "x": None, "\U00010000": 2e20, "￿": 0.1}, {}, None] if k % 3 else None, "a": {"É": pick(), "E": rng.choice([True, False, None])} if k % 4 else None}
        rows.append((k, deep, rng.choice([None, [], [[1, None], [], None]]), rng.choice([None, {}, {"k\n": [pick(), pick()], "A": [], "a": None}]), rng.choice([None, datetime.date(2024, 2, 29)]), rng.choice([None, Decimal("1.50")]), pick()))
    got = contexts.context_hash(spark.createDataFrame(rows, SCHEMA), "id").collect()
    names = ("z", "a b", "m", "d", "n", "t")
    for r, row in zip(sorted(got, key=lambda r: r.id), rows, strict=True):
        said = json.dumps(dict(zip(names, row[1:], strict=True)), sort_keys=True, ensure_ascii=False, default=str)
        assert r.input_hash == hashlib.sha256(said.encode()).hexdigest(), said


def test_unicode_forms(spark):
    texts = ["Straße", "STRASSE", "straße", "é", "é", "É", "ΑΣ", "ας", "ﬁ", "İ", "ı", "Å", "Å", "가", "가", "plain", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical.nfc(F.col("t")).alias("n"), canonical.casefolded(F.col("t")).alias("f")).collect()
    for r in rows:
        assert (r.n, r.f) == ((None, None) if r.t is None else (unicodedata.normalize("NFC", r.t), r.t.casefold()))
    labels = spark.createDataFrame([("Straße :",), ("STRASSE",)], "t string").select(text.label(F.col("t"))).distinct().collect()
    assert [r[0] for r in labels] == ["strasse"]
    listed = spark.createDataFrame([(1, "café  Größe.PDF"), (1, "other")], "id long, name string")
    shown = spark.createDataFrame([(1, "CAFÉ GRÖSSE.pdf"), (2, "other")], "id long, name string")
    assert {r.name[0]: r.on_page for r in probes.matched_names(listed, shown, "id", "name").collect()} == {"c": True, "o": False}
