"""Operators against brute force, exact round trips and held-out accuracy."""

import bisect
import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import duck, duck_rows, spark_rows
from dossier.llm import chat, decontamination, language_id, mixing, near_dedup, registry, sharding, substring_dedup, warc, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == duck_rows(duck(SF), registry.oracle_sql()[name], columns)


def test_registered():
    names = entry.queries()
    assert {f"op{i}" for i in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_words():
    texts = ["a\x0bb  c", None, "", "d\u00a0e", " x", "é "]
    (chunk,) = words.chunks(pa.array(texts))
    assert [chunk.words(i) for i in range(6)] == [(t or "").encode().split() for t in texts]
    assert np.diff(chunk.doc_words).tolist() == [3, 0, 0, 1, 1, 1]
    again = np.concatenate([c.hashes() for c in words.chunks(pa.array(["zz b", "zz c"]), most=1)])
    assert again[0] == again[2] and len(set(again.tolist())) == 3


def test_substring_dedup_against_brute_force(spark):
    rng = random.Random(3)
    passages = [[f"p{k}_{rng.randrange(30)}" for _ in range(70)] for k in range(4)]
    rows = []
    for i in range(80):
        w = [f"u{rng.randrange(50)}" for _ in range(rng.randrange(0, 120))]
        if i % 2:
            w[10:10] = rng.choice(passages)[: rng.randrange(45, 70)]
        rows.append((i % 60, " ".join(w)))
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=2000, slice_entries=50).collect())
    least = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            least[key] = min(i, least.get(key, i))
    expected = []
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(expected)
    assert sum(r[2] for r in got) > 500


def test_saturated_sketch_loses_nothing(spark, documents):
    a = substring_dedup.substring_dedup(documents, max_counters=substring_dedup.SHARD, counters_per_window=0.0001)
    b = substring_dedup.substring_dedup(documents)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_language_id_on_held_out_documents(spark, documents):
    rows = registry.queries()["op2_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    sure = [r for r in rows if r.score > 0.9]
    assert abs(sum(r.lang == r.lang_pred for r in sure) / len(sure) - sum(r.score for r in sure) / len(sure)) < 0.05


def test_lm_scores(spark, documents):
    got = {r.doc_id: r for r in registry.queries()["op3_lm_scoring"](spark, SF).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r.doc_id: [*(r.text or "").translate(low).encode().split(), None] for r in documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = collections.Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def labelled(w, k=5):
    seen, out = collections.Counter(), []
    for i in range(len(w) - k + 1):
        s = tuple(w[i : i + k])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def similarity(a, b):
    place = {x: j for j, x in enumerate(b)}
    chain = []
    for x in a:
        if x in place:
            j = bisect.bisect_left(chain, place[x])
            chain[j : j + 1] = [place[x]]
    return len(chain) / (len(a) + len(b) - len(chain))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 50)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            texts[len(texts)] = w
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}
    sets = {i: labelled(w) for i, w in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in texts:
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 - 1e-12:
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert links > 50
    assert got == {i: find(i) for i in texts}


def test_drifting_group_is_one_class(spark):
    """Neighbours are alike, the ends are not: no single pivot reaches all."""
    w = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        w[(i * 37) % 150] = f"n{i}"
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_retrieval_is_whole():
    """Block-max WAND finds what scoring every item finds."""
    rng = random.Random(2)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(4, 30)))) for i in range(90)]
    for index in decontamination.build_indexes(items, 0.35):
        admitted = np.ones(index.n_blocks, dtype=bool)
        for _ in range(120):
            query = sorted({rng.randrange(len(index.vocabulary)) for _ in range(rng.randrange(1, 25))})
            scores = collections.Counter()
            for t in query:
                for i, x in zip(*index.postings[t]):
                    scores[i] += x
            expected = {i for i, s in scores.items() if s >= 0.35 - 1e-9}
            assert {i for i, _ in index.retrieve(query, admitted)} == expected


def test_decontamination_finds_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in registry.queries()["op9_decontamination"](spark, sf).collect()}
    expected = {(d.doc_id, i.item_id) for d in docs.collect() for i in items if " ".join(i.text.split()) in " ".join(d.text.split())}
    assert expected and expected <= got
    assert len(got - expected) <= 0.1 * len(expected) + 1
    changed = [f"x{k}" for k in range(40)] + ["a" if k % 9 == 4 else w for k, w in enumerate(items[0].text.upper().split())] + [f"y{k}" for k in range(40)]
    near = decontamination.contaminated_pairs(spark.createDataFrame([(1, " ".join(changed))], "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert [r.item_id for r in near.collect()] == [items[0].item_id]


def test_common_words():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 20))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontamination.common_words(a, b) == table[-1, -1]


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_inverse_demand(spark):
    schedule = ((0.0, 2.0), (0.3, 0.5), (0.6, 0.5), (1.0, 3.0))
    shares = [i / 50 for i in range(50)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.inverse_demand(F.col("s"), schedule)).collect()]
    area = lambda t: sum((min(t, b) - a) * (u + u + (v - u) * (min(t, b) - a) / (b - a)) / 2 for (a, u), (b, v) in zip(schedule, schedule[1:]) if t > a)
    assert [area(t) / area(1.0) for t in got] == pytest.approx(shares, abs=1e-9)


def test_mix_meets_its_targets(spark, documents):
    rows = mixing.curriculum(documents).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert [r.first_position for r in rows if r.first_position is not None] == sorted(r.first_position for r in rows if r.first_position is not None)


def test_weighted_shards(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    weights = (1.0, 2.0, 4.0)
    rows = sharding.shard_rows(docs, weights=weights, grown_weight=1.0).collect()
    share = collections.Counter(r.shard for r in rows)
    assert [share[s] / 30_000 for s in range(3)] == pytest.approx([w / 7 for w in weights], abs=0.02)
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {3} and len(moved) / 30_000 == pytest.approx(1 / 8, abs=0.01)
    grown = {r.doc_id: r.shard for r in sharding.shard_rows(docs, weights=(*weights, 1.0)).collect()}
    assert grown == {r.doc_id: r.grown_shard for r in rows}


def test_chat_parts(spark):
    schema = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:bigint>>"
    rows = [(1, 1, "user", [("text", "see <b>", None, None), ("image", None, "i.png", 3), ("video", None, "v", None)]), (1, 2, "assistant", [("text", "a\\", None, None), ("audio", None, "s.wav", 10), ("text", "<b>", None, None)]), (1, 3, "user", None)]
    r = chat.formatted_conversations(spark.createDataFrame(rows, schema)).withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert r.formatted == "<turn user>\nsee \\lb\\g<image><file>\n</turn>\n<turn assistant>\na\\b<audio>\\lb\\g\n</turn>\n<turn user>\n\n</turn>\n"
    assert [r.formatted[s.at - 1 : s.at - 1 + s.chars] for s in r.loss_spans] == ["a\\b", "\\lb\\g"]
    assert [tuple(a) for a in r.attachments] == [(1, "image", "i.png", 768), (1, "video", "v", 1), (2, "audio", "s.wav", 250)]
    assert r.expanded_tokens == 1019
    assert [t.text for t in r.turns] == ["see <b>", "a\\<b>", ""]


def test_pipeline_against_its_stages(spark, documents):
    """What each stage drops is what its operator names; the result is the sharded mix of the rest."""
    accepted = {r.doc_id for r in language_id.accepted_documents(documents).collect()}
    classes = near_dedup.near_duplicates(documents.where(F.col("doc_id").isin(*accepted))).collect()
    kept = {r.doc_id for r in classes if r.doc_id == r.class_id}
    leaks = {r.doc_id for r in decontamination.contaminated_pairs(documents, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    rest = documents.where(F.col("doc_id").isin(*(kept - leaks)))
    copies = collections.Counter({r.doc_id: r.copies for r in mixing.curriculum(rest).collect() if r.copies})
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in got) == copies
    assert len(accepted) > 0.95 * documents.count()


def test_tiles_against_all_pairs():
    """Numbers of shared shingles, and links enough to join classes."""
    rng = random.Random(9)
    for _ in range(12):
        base = rng.sample(range(10**6), 60)
        labels = []
        for _ in range(rng.randrange(2, 40)):
            own = [x if rng.random() > 0.08 else rng.randrange(10**6) for x in base[rng.randrange(4) :]]
            labels.append(np.array(list(dict.fromkeys(own)), dtype=np.uint64))
        shared = near_dedup._shared(labels)
        assert all(shared[i, j] == len(set(labels[i].tolist()) & set(labels[j].tolist())) for i in range(len(labels)) for j in range(len(labels)) if i != j)
        links = near_dedup._tile_links(list(range(len(labels))), list(range(len(labels))), [0] * len(labels), both := [[x, words.mix(x)] for x in labels], 0.8)
        true = [(i, j) for i in range(len(labels)) for j in range(i) if near_dedup.aligned_similarity(both[i], both[j], 0.8) >= 0.8]

        def classes(pairs):
            root = list(range(len(labels)))
            for _ in root:
                for i, j in pairs:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        assert classes(links) == classes(true) and len(links) < len(labels)


def test_large_bucket_of_unlike_copies(spark):
    """More near copies than a small bucket lists, most of them too far from the pivot."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 9)):
            w[k] = f"e{i}_{k}"
        texts[i + 5] = w
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}
    sets = {i: labelled(w) for i, w in texts.items()}
    root = {i: i for i in texts}
    for _ in range(6):
        for i in texts:
            for j in texts:
                if i != j and root[i] != root[j] and similarity(sets[i], sets[j]) >= 0.8 - 1e-12:
                    root[i] = root[j] = min(root[i], root[j])
    assert got == root


def test_packed_steps():
    rng = np.random.default_rng(3)
    for most in (2, 200, 300, 5000, 10**6):
        steps = rng.integers(0, most, 400)
        steps[0] += 1
        blob = substring_dedup._packed(steps)
        assert substring_dedup._unpacked(blob).tolist() == np.cumsum(steps).tolist()
        assert blob[0] == {2: 1, 200: 1, 300: 1, 5000: 2, 10**6: 4}[most]


def test_written_shards(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "shards"), weights=(1.0,) * 5, files_a_shard=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    placed = {r.doc_id: r.shard for r in sharding.shard_rows(documents, weights=(1.0,) * 5).collect()}
    assert {r.doc_id: r.shard for r in back.select("doc_id", "shard").collect()} == placed
    assert back.count() == documents.count()


def test_language_scores_against_brute_force(spark, documents):
    """Predictions are the softmax of the mean of each byte 2-, 3- and 4-gram's logits."""
    model = language_id.fit(documents, usable=F.lit(True), most_documents=120)
    odd = ["", "a", "é", "ab", "The  Tab\tand\nline", "zażółć gęślą jaźń", "x" * 5000, "12 34"]
    rows = language_id.identify(documents.select("doc_id", "text").limit(40).union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")), model).collect()
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
    for r in rows:
        data = (r.text or "").encode().translate(low)
        grams = [data[i : i + k] for k in (2, 3, 4) for i in range(len(data) - k + 1)]
        bucket = [((int.from_bytes(g, "big") + (len(g) << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> 48 for g in grams]
        logits = (model.table[bucket].astype(float).mean(axis=0) if bucket else 0) + model.bias
        p = np.exp((logits - logits.max()) / model.temperature)
        if any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == model.languages[int(p.argmax())] and r.score == pytest.approx(float(p.max() / p.sum()), abs=1e-5)
            assert r.lang_accepted == (r.score >= model.least_score)
        else:
            assert (r.lang_pred, r.score, r.lang_accepted) == ("und", 0.0, False)


def test_shards_against_brute_force(spark, documents):
    """Each key's winner among 40 and 41 shards, and slots without gaps."""
    import xxhash

    def draw(key, shard):
        first = xxhash.xxh64_intdigest(key.encode(), 42)
        return -math.log(((xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), first) >> 11) + 0.5) / 2**53)

    rows = registry.queries()["op10_sharding"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        draws = [draw(str(r.doc_id), s) for s in range(41)]
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.shard == draws.index(min(draws[:40])) and r.grown_shard == draws.index(min(draws))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_follow_the_order_of_training(spark, documents):
    from dossier.llm.scratch import stored

    position = {r.doc_id: r.first_position for r in mixing.curriculum(documents).collect()}
    mixed = stored(mixing.mixed_documents(documents), "mixed")
    once = collections.Counter(r.doc_id for r in mixed.collect())
    rows = sharding.shard_rows(mixed, as_read=True).collect()
    assert collections.Counter(r.doc_id for r in rows) == once
    for shard in {r.shard for r in rows}:
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        places = [position[r.doc_id] for r in own if once[r.doc_id] == 1]
        assert places == sorted(places)


def test_decontamination_against_brute_force(spark):
    """All pairs of a document and an item, by scoring every item against every passage."""
    rng = random.Random(3)
    vocabulary = [f"v{int(rng.paretovariate(0.5)) % 400}" for _ in range(5000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(120)]
    docs = []
    for k in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        if rng.random() < 0.6:
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x if rng.random() > 0.12 else "zz" for x in rng.choice(items)[1].split()]
        docs.append((k, " ".join(w)))
    expected = set()
    classes = collections.defaultdict(list)
    for i, t in items:
        classes[max(5, (len(t.split()) - 1).bit_length())].append((i, t.split()))
    for own in classes.values():
        df = collections.Counter(x for _, w in own for x in set(w))
        mean, longest = np.mean([len(w) for _, w in own]), max(len(w) for _, w in own)
        cell = -(-longest // 2)
        for i, w in own:
            weight = {x: math.log1p((len(own) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, n in collections.Counter(w).items()}
            cut = len(w) - max(1, len(w) // 3)
            for k, text in docs:
                d = text.split()
                cells = -(-len(d) // cell)
                for c in range(cells):
                    if c and c > cells - 3:
                        continue
                    a, b = c * cell, min(c * cell + 3 * cell, len(d))
                    if sum(weight.get(x, 0) for x in set(d[a:b])) / sum(weight.values()) < 0.6 - 1e-9:
                        continue
                    around = d[max(0, a - len(w)) : b + len(w)]
                    number = {x: n for n, x in enumerate(sorted({*w, *around}))}
                    common = [decontamination.common_words([number[x] for x in p], [number[x] for x in around]) / len(p) if p else 1.0 for p in (w[:cut], w[cut:])]
                    if min(common) >= 0.8:
                        expected.add((k, i))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated_pairs(*frames).collect()} == expected
    assert len(expected) > 40
    kept = {r.doc_id for r in decontamination.clean_documents(*frames).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in expected}


def test_sketch_stays_a_prefilter(spark):
    """However many counters a range has, few unrepeated windows pass, and more documents don't let more pass."""
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(400)]
    shares = []
    for n in (100, 400):
        table = pa.table({"doc_id": [i for i, _ in docs[:n]], "text": [t for _, t in docs[:n]], "grp": [0] * n})
        shard = 1 << 12
        counters = int(2.2 * n * 400) // shard * shard
        hits = substring_dedup._hit(50, counters, shard)(table)
        said = pa.concat_tables([substring_dedup._merged(shard)(hits.filter(pa.compute.equal(hits["part"], p))) for p in set(hits["part"].to_pylist())])
        found = substring_dedup._Candidates(table, said, 50, counters, shard, 4)
        shares.append(len(found.doc) / (n * 351))
    assert max(shares) < 0.2 and abs(shares[0] - shares[1]) < 0.03
