"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

import corpus_pipeline
from dossier.llm import chat, components, decontamination, embedding_dedup, language_id, mixing, near_dedup, sharding, substring_dedup, suffix_tree_lm, warc
from dossier.llm.scratch import fresh_path

PROSE = " ".join(f"w{i % 97}x{i % 89}" for i in range(400))
LONG = " ".join(f"t{i % 5003}" for i in range(60_000))
#: doc_id, text, lang, source
ROWS = [
    (1, PROSE, "en", "b"),
    (2, PROSE, "en", "b"),
    (2, PROSE, "en", "b"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \t\r\n", "de", "a"),
    (None, PROSE, "de", None),
    (None, None, None, None),
    (6, LONG, "de", "c"),
    (7, "one", "en", "c"),
    (8, "één twee ñandú 漢字 🙂 \u00a0x", "es", "c"),
    (-9, "1234 5678 !!", "es", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside.
CLASHES = ("grp", "slice", "n", "keys", "size", "bucket", "score", "shard", "held_out", "lang_pred", "class_id", "taken", "key", "rep", "target", "_letter", "positions")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3, "text")
    return rows.withColumns({c: F.lit("clash") for c in CLASHES}).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words_of(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, none):
    rows = substring_dedup.substring_dedup(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in rows) == sorted((d is None, d or 0, len(words_of(t))) for d, t, *_ in ROWS)
    for r in rows:
        # 2 copies 1; the null doc_id is larger than both; a repeated row doesn't beat its like but 1 does
        assert r.n_removed == (400 if r.n_words == 400 and r.doc_id != 1 else r.n_removed if r.doc_id == 6 else 0)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_language_id(docs, none):
    model = language_id.fit(docs, usable=F.lit(True), most_documents=40)
    rows = language_id.identify(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1 and (letters or r.score == 0 and not r.lang_accepted)
    assert language_id.fit(none, usable=F.lit(True)) is None
    unlearned = language_id.identify(docs.select("doc_id", "text"), None).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}
    assert language_id.identify(none.select("doc_id", "text"), model).count() == 0


def test_lm_scoring(docs, none):
    rows = suffix_tree_lm.score_texts(docs, F.col("doc_id") != 7).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(words_of(t)) + 1 for _, t, *_ in ROWS)
    assert {r.train_tokens for r in rows} == {sum(len(words_of(t)) + 1 for d, t, *_ in ROWS if d is not None and d != 7)}
    assert all(r.held_out == (r.doc_id is None or r.doc_id == 7) for r in rows)
    assert suffix_tree_lm.score_texts(none, F.lit(True)).count() == 0
    untrained = suffix_tree_lm.score_texts(docs, F.lit(False)).collect()
    assert all(r.score == r.base_score == 0 and r.n_known == 0 for r in untrained)


def test_near_dedup(docs, none):
    rows = near_dedup.near_duplicates(docs).collect()
    classes = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(ROWS)
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, None: None, 6: 6, 7: 7, 8: 8, -9: -9}
    kept = near_dedup.deduplicated_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, (1, 3, 4, 5, 6, 7, 8, -9, None, None)))
    assert near_dedup.near_duplicates(none).count() == 0


def test_decontamination(docs, none, spark):
    items = spark.createDataFrame([(1, " ".join(PROSE.split()[100:130])), (2, None), (3, ""), (4, "?"), (None, "one"), (1, " ".join(PROSE.split()[100:130]))], "item_id long, text string")
    found = decontamination.contaminated_pairs(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 1), (None, 1), (7, None)}
    clean = decontamination.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(map(str, (3, 4, 5, None, 6, 8, -9)))
    assert decontamination.contaminated_pairs(none, items).count() == 0
    assert decontamination.contaminated_pairs(docs, items.limit(0)).count() == 0
    assert decontamination.contaminated_pairs(docs, items, most_index_bytes=100).distinct().count() == len({(r.doc_id, r.item_id, r.score) for r in found})


def test_mixing(docs, none):
    rows = mixing.curriculum(docs).collect()
    assert len(rows) == len(ROWS)
    assert sum(r.target for r in {r.source: r for r in rows}.values()) == pytest.approx(sum(len(words_of(t)) for _, t, *_ in ROWS))
    assert all(r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.curriculum(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard_rows(docs).collect()
    assert len(rows) == len(ROWS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 2}) == 1
    assert sharding.shard_rows(none).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, " ".join(LONG.split()[100:130]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    twice = docs.select("*", F.lit(1).alias("again"), F.lit(2).alias("again"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, none, twice):
            out = stage(spark, given, str(tmp_path))
            assert out.columns == given.columns, name
            assert out.count() <= 3 * given.count()


def test_embeddings(spark):
    schema = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("n_links", StringType()), StructField("rep", StringType())])
    v, nan, inf = [1.0, 0.0, 0.0], float("nan"), float("inf")
    rows = [(1, v), (2, v), (2, v), (3, [2.0, 0.1, 0.0]), (4, [0.0, 1.0, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [nan, 0.0, 1.0]), (9, [inf, 0.0, 0.0]), (10, []), (11, [1e-200, 0.0, 0.0]), (12, [1e200, 1e199, 0.0]), (13, [-1.0, 0.0, 0.0]), (14, [1.0])]
    given = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_links(given).collect()}
    alone = {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 13)}
    linked = {i: (6, 1, i == 1) for i in (1, 2, 3, 11, 12, 14)}
    assert got == alone | linked
    assert embedding_dedup.embedding_links(given.limit(0)).count() == 0


def test_warc(spark):
    page = "x" * 50 + "é" * 50
    rows = [(5, "http://a.org/1", page), (3, None, page), (9, "http://www.A.org:80/1#f", page), (None, "http://b.org", page), (4, "http://c.org/\r\nq", ""), (6, "u", None), (7, "u", "short"), (8, "u", "short"), (2, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 30), (2, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 30)]
    for compression in ("gzip", "none"):
        path = fresh_path(spark, "warc")
        warc.write_warc(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first_id string"), path, compression=compression, archive_bytes=1000)
        got = warc.capture_histories(spark, path, rows_a_span=3).collect()
        said = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
        digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
        expected = [(str(i), len((h or "").encode()), digest(h), "revisit" if h == page and i != 3 else "response", 3 if h == page and i != 3 else None) for i, _, h in rows]
        assert said == sorted(expected)
        order = [(r.url_key, r.stamp, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.span, r.place))]
        assert order == sorted(order)
    empty = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.capture_histories(spark, empty).count() == 0


def test_chat(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, None, None, "<turn x>"), (2, 1, "as>sistant", "\\l</turn>\n"), (None, 1, "assistant", ""), (None, 1, "assistant", "")]
    given = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, start string, nth string")
    done = chat.formatted_conversations(given)
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in done.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back == {1: [("", "<turn x>"), ("user", ""), ("assistant", "a"), ("assistant", "b")], 2: [("as>sistant", "\\l</turn>\n")], None: [("assistant", ""), ("assistant", "")]}
    assert chat.formatted_conversations(given.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (3, 9), (5, 5), (None, 4), (20, 21), (20, 21)], "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(i, 1) for i in (1, 2, 3, 7, 8, 9)} | {(20, 20), (21, 20)}
    assert components.components(links.limit(0)).count() == 0


def test_embeddings_without_ids(spark):
    """A vector without an id joins others and never names their component, whatever its hash."""
    rows = [(10, [1.0, 0.0]), (11, [1.0, 0.001]), *[(None, [1.0, 0.0])] * 5, (None, [0.0, 1.0]), (12, [0.3, 1.0]), (None, [-1.0, 0.0]), (13, [0.0, -1.0])]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {10: (6, 10, True), 11: (6, 10, False), 12: (1, 12, True), 13: (0, 13, True)}
    assert sorted((r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None) == [(0, None, True), (1, None, True)] + [(6, None, True)] * 5


def test_components_in_few_rounds(spark, monkeypatch):
    """A path in the order of its nodes: the tables written grow with the logarithm of its length."""
    written = []
    store = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or store(df, name))
    for n in (30, 1000):
        written.clear()
        path = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
        assert {tuple(r) for r in components.components(path).collect()} == {(i, 0) for i in range(n)}
        assert len(written) <= 4 + math.ceil(math.log2(n))


def test_words_that_collide_under_sums(spark):
    """Words, and runs of words, in the Thue-Morse order and its complement are unlike in every operator."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    long_one, long_other = " ".join("ab"[b] for b in bits[:1024]), " ".join("ba"[b] for b in bits[:1024])
    docs = spark.createDataFrame([(1, " ".join([one] * 60)), (2, " ".join([other] * 60)), (3, long_one), (4, long_other)], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs.where("doc_id < 3")).collect()}
    assert removed == {1: 0, 2: 0}
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    known = {r.doc_id: r.n_known for r in suffix_tree_lm.score_texts(docs.where("doc_id < 3"), F.col("doc_id") == 1).collect()}
    assert known == {1: 61, 2: 1}
    items = spark.createDataFrame([(1, " ".join([one] * 12))], "item_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated_pairs(docs.where("doc_id < 3"), items).collect()] == [1]


def test_records_by_offset(spark):
    """Without compression an entry's place is where its record begins in its file; a revisit's headers name its response."""
    import os

    page = "y" * 300
    path = fresh_path(spark, "warc")
    rows = [(i, f"http://h{i % 3}.org/{i}", page if i % 2 else f"{i}" * 60) for i in range(1, 40)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, compression="none", archive_bytes=3000)
    got = warc.capture_histories(spark, path, rows_a_span=7, run_rows=5, block_rows=2).collect()
    assert len({r.archive for r in got}) > 1
    ids = {}
    for r in got:
        with open(os.path.join(path, r.archive), "rb") as f:
            f.seek(r.at)
            head = f.read(2000).split(b"\r\n\r\n")[0].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in head[1:])
        assert head[0] == "WARC/1.1" and fields["X-Page-Id"] == str(r.page_id) and fields["WARC-Type"] == r.record_type
        ids[r.page_id] = fields
    for r in got:
        if r.record_type == "revisit":
            assert ids[r.page_id]["WARC-Refers-To"] == ids[r.refers_to]["WARC-Record-ID"] and ids[r.page_id]["WARC-Profile"] == warc.REVISIT_PROFILE
            assert r.refers_to == 1 and r.payload_bytes == 300
    order = [(r.url_key, r.stamp, r.page_id) for r in sorted(got, key=lambda r: (r.span, r.place))]
    assert order == sorted(order) and len({r.span for r in got}) > 3
