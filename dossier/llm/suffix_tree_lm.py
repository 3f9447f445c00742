"""Scoring texts with a probabilistic suffix tree over words.

The tree's symbols are all words of the training texts and the end of a text; its
contexts are runs of up to max_depth words, the oldest of which may be a text's start.
A context stays if its next symbols diverge from those of its suffix by a
log-likelihood ratio of at least penalty * ln(tokens), and with it its suffixes.
Next-symbol distributions are smoothed towards the suffix's (Witten-Bell), down to
the unigram distribution, and each token is scored in the state of the longest
suffix of its history that stayed.

Candidates are the contexts that can matter.  A symbol that follows a context of n
places m times has at least the chance m / (2 * s + 1) after its suffix of s places,
so that the ratio is at most n * ln((2 * s + 1) / n); over all n that is at most
(2 * s + 1) / e.  A context is left out if the first bound, or the greatest value it
takes for fewer places, and the second one for the contexts that end with it, are both
below the limit.  Both fall when a context or its suffix gets longer on either side, so
that nothing longer that holds it can stay: leaving it out changes no score.

Counts are exact, cover all training texts, and grow with them; none is sent to
every task.  Groups of documents ask slices of the hash space for what they need and
get it back, level by level: for the counts and numbers of their distinct words, then
for each length of contexts, of which the counts of the level before tell the
candidates, for the counts of their (context, next symbol) pairs, and how many next
symbols each context has and whether it diverges.  Numbers are small for frequent
words, so that texts and the next symbols of a context take a byte or two a word.  A suffix that another context keeps is found by
a join.  A context with more than hot places is asked for in parts by next symbol;
the sums of these parts, at most tokens / hot contexts a level, are all that passes
the driver.
"""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import words
from dossier.llm.language_id import remainder
from dossier.llm.scratch import dropped, stored

_U = np.uint64
SYMBOL_BITS = 44  #: of a word's number
END = (_U(0x5851F42D4C957F2D), _U(0x2545F4914F6CDD1D))  #: stand for the end of a text among both hashes of words
START = _U(0x14057B7EF767814F)  #: stands for the start of a text in contexts; no word's number is as large
_ODD = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93))
HOT = np.dtype([("c", "<u8"), ("suffix", "<u8"), ("n", "<f8"), ("kinds", "<f8"), ("gain", "<f8")])

ASKED = "grp long, slice long, docs binary, n long, keys binary, sizes binary, gains binary, suffixes binary, entries binary, counts binary, hot binary"
CODED = "grp long, docs binary"
ANSWERED = "grp long, slice long, counts binary, numbers binary, contexts binary, asks binary, up binary, hot binary, n_words long, n_tokens long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _table(rows: list[dict], ddl: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_schema(ddl))


def sequences(column) -> tuple[list[np.ndarray], np.ndarray]:
    """Both hashes of all tokens, A-Z as a-z, each text followed by its end; offsets of the texts."""
    hashes, counts = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]], [np.zeros(0, np.int64)]
    for chunk in words.chunks(column):
        for out, h, end in zip(hashes, chunk.both_hashes(lower=True), END, strict=True):
            out.append(np.insert(h, chunk.doc_words[1:], end))
        counts.append(np.diff(chunk.doc_words) + 1)
    return [np.concatenate(h) for h in hashes], words.prefix(np.concatenate(counts))


def _slice_starts(n: int) -> np.ndarray:
    return (np.arange(n, dtype=object) * (1 << 64) // n).astype(np.uint64)


def _narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as hold them all, compressed place by place of these; headed by width and length."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)
    return bytes([kind.itemsize]) + len(values).to_bytes(7, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _wide(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], n * width, "zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def _joined(parts: list, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _packed(docs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(docs)
    return sink.getvalue().to_pybytes()


def _word_requests(n_slices: int):
    """A group's texts, packed, as slice -1, and its distinct words with their counts in its training texts by slice."""

    def run(docs: pa.Table) -> pa.Table:
        h, offsets = sequences(docs.column("text"))
        train = np.repeat(docs.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(offsets))
        keys, second, inverse = words.distinct_pairs(*h)
        del h
        counts = np.bincount(inverse[train], minlength=len(keys))
        group = docs.column("grp")[0].as_py()
        cuts = np.searchsorted(keys, _slice_starts(n_slices))
        out = [{"grp": group, "slice": -1, "docs": _packed(docs.select(["doc_id", "text", "train"]))}]
        for s, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)):
            if b > a:
                out.append({"grp": group, "slice": s, "n": int(b - a), "keys": keys[a:b].tobytes() + second[a:b].tobytes(), "counts": _narrow(counts[a:b])})
        return _table(out, ASKED)

    return run


def _word_answers(table: pa.Table) -> pa.Table:
    """Total counts for each group's words, and their ranks by count in the slice; with a slice's first answer its number of words and its tokens."""
    both = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in table.column("keys").to_pylist()]
    word, _, inverse = words.distinct_pairs(*(_joined([b[i] for b in both], np.uint64) for i in (0, 1)))
    total = np.bincount(inverse, weights=_joined([_wide(b) for b in table.column("counts").to_pylist()], np.int64)).astype(np.int64)
    rank = np.empty(len(word), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(word))
    out, at = [], 0
    for group, s, n in zip(*(table.column(c).to_pylist() for c in ("grp", "slice", "n")), strict=True):
        own = inverse[at : at + n]
        out.append({"grp": group, "slice": s, "counts": _narrow(total[own]), "numbers": _narrow(rank[own])})
        at += n
    out[0] |= {"n_words": int((total > 0).sum()), "n_tokens": int(total.sum())}
    return _table(out, ANSWERED)


def _coded(n_slices: int):
    """A group's texts as numbers of words, with the counts of these."""

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        docs = pa.ipc.open_stream(packed.column("docs")[0].as_py()).read_all()
        h, offsets = sequences(docs.column("text"))
        said = answers.sort_by("slice").to_pylist()
        counts = _joined([_wide(r["counts"]) for r in said], np.int64)
        numbers = _joined([_wide(r["numbers"]) * n_slices + r["slice"] for r in said], np.int64)
        tokens = words.distinct_pairs(*h)[2]
        del h
        own = np.argsort(-np.bincount(tokens, minlength=len(counts)), kind="stable")  # frequent words first
        place = np.empty(len(own), np.int64)
        place[own] = np.arange(len(own))
        blob = pa.table({"doc_id": docs.column("doc_id"), "train": docs.column("train"), "n": pa.array(np.diff(offsets))})
        parts = {"docs": _packed(blob), "tokens": _narrow(place[tokens]), "numbers": _narrow(numbers[own]), "counts": _narrow(counts[own])}
        return pa.table({"grp": packed.column("grp")[:1], "docs": pa.array([_packed(pa.table({k: [v] for k, v in parts.items()}))])})

    return run


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and which of them is at each place; places in four bytes."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(values), dtype=np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ordered[new], order[new].astype(np.int32), which


class _Asked:
    """The distinct (context, next symbol) pairs of a group's places, in the order of their slices."""

    def __init__(self, c: np.ndarray, x: np.ndarray, n: np.ndarray, hot: int) -> None:
        """Contexts, next symbols and counts of the contexts at places."""
        parts = (1 + n // hot).astype(np.uint64)
        shard = np.where(parts > 1, words.mix(c + (1 + x % parts) * _ODD[2]), c) if (parts > 1).any() else c
        self.shards, _, at = _distinct(shard)  #: of each context or part: its hash
        pairs = at.astype(np.uint64) << _U(SYMBOL_BITS)
        del at
        pairs |= x
        pairs, self.first, self.entry_at = _distinct(pairs)  #: a place of each pair, and the pair of each place
        owner = (pairs >> _U(SYMBOL_BITS)).astype(np.int32)
        self.entries = (pairs & _U((1 << SYMBOL_BITS) - 1)).astype(np.int64)
        self.starts = np.searchsorted(owner, np.arange(len(self.shards)))
        self.of = self.first[self.starts]
        self.sizes = np.diff(np.append(self.starts, len(pairs)))
        self.context_at = owner[self.entry_at]
        self.split = np.flatnonzero(parts[self.of] > 1)

    def rows(self, group: int, c: np.ndarray, suffix: np.ndarray, p: np.ndarray, train: np.ndarray, n_slices: int) -> list[dict]:
        """Requests; suffixes, chances after these and whether they are trained on are those of the places."""
        counts = np.bincount(self.entry_at[train], minlength=len(self.entries))
        gains = np.add.reduceat(counts * np.log(p[self.first]), self.starts) if len(self.starts) else np.zeros(0)
        cuts = [*np.searchsorted(self.shards, _slice_starts(n_slices)), len(self.shards)]
        edges = np.append(self.starts, len(self.entries))
        steps = np.diff(self.entries, prepend=0)
        steps[self.starts] = self.entries[self.starts]
        hot = np.zeros(len(self.split), np.dtype([("at", "<i8"), ("c", "<u8")]))
        hot["at"], hot["c"] = self.split, c[self.of[self.split]]
        out = []
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                part, mine = slice(edges[a], edges[b]), hot[(hot["at"] >= a) & (hot["at"] < b)].copy()
                mine["at"] -= a
                out.append({
                    "grp": group, "slice": s, "n": int(b - a), "keys": self.shards[a:b].tobytes(), "sizes": _narrow(self.sizes[a:b]), "gains": gains[a:b].tobytes(),
                    "suffixes": _narrow(suffix[self.of[a:b]]), "entries": _narrow(steps[part]), "counts": _narrow(counts[part]), "hot": mine.tobytes(),
                })
        return out


def _pair_answers(least_ratio: float):
    """For each group's pairs their counts, and of their contexts whether they diverge and the number of next symbols.

    Asks are a group's contexts that don't diverge, with their suffixes; up, with a slice's first answer, the suffixes of those that do.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("grp")  # sums in the same order in each run
        read = lambda name, kind: _joined([np.frombuffer(b, kind) for b in table.column(name).to_pylist()], kind)
        wide = lambda name: _joined([_wide(b) for b in table.column(name).to_pylist()], np.int64)
        keys, first, context = np.unique(read("keys", np.uint64), return_index=True, return_inverse=True)
        sizes, suffixes = wide("sizes"), wide("suffixes").view(np.uint64)
        symbols = np.cumsum(wide("entries"))
        at = np.append(0, np.cumsum(sizes)[:-1])
        symbols -= np.repeat(np.append(0, symbols)[at], sizes)
        pairs, inverse = np.unique(np.repeat(context, sizes) << SYMBOL_BITS | symbols, return_inverse=True)
        owner = pairs >> SYMBOL_BITS
        total = np.bincount(inverse, weights=wide("counts"), minlength=len(pairs))
        n = np.bincount(owner, weights=total, minlength=len(keys))
        kinds = np.bincount(owner[total > 0], minlength=len(keys))
        gain = np.bincount(owner, weights=total * np.log(np.maximum(total, 1)), minlength=len(keys))
        gain -= np.bincount(context, weights=read("gains", np.float64), minlength=len(keys))
        stays = gain - n * np.log(np.maximum(n, 1)) >= least_ratio
        split = np.zeros(len(keys), np.uint64)
        groups, slices, ns = (table.column(c).to_pylist() for c in ("grp", "slice", "n"))
        names, at = read("keys", np.uint64).copy(), 0
        for blob, k in zip(table.column("hot").to_pylist(), ns, strict=True):
            mine = np.frombuffer(blob, np.dtype([("at", "<i8"), ("c", "<u8")]))
            split[context[at + mine["at"]]] = names[at + mine["at"]] = mine["c"]
            at += k
        parted = np.flatnonzero(split)
        stays[parted] = False
        hot = np.zeros(len(parted), HOT)
        hot["c"], hot["suffix"], hot["n"], hot["kinds"], hot["gain"] = split[parted], suffixes[first[parted]], n[parted], kinds[parted], gain[parted]
        out, at, entry = [], 0, 0
        for group, s, k in zip(groups, slices, ns, strict=True):
            mine, m = context[at : at + k], int(sizes[at : at + k].sum())
            not_yet = np.flatnonzero(~stays[mine] & ((2 * n[mine] + 1) / np.e >= least_ratio * (1 - 1e-9)) | (split[mine] > 0))  # that may be the suffix of one that does
            out.append({
                "grp": group, "slice": s, "counts": _narrow(total[inverse[entry : entry + m]].astype(np.int64)), "contexts": _narrow(kinds[mine] * 2 + stays[mine]),
                "asks": np.stack([names[at + not_yet], suffixes[at + not_yet]], axis=1).tobytes(),
            })
            at, entry = at + k, entry + m
        out[0] |= {"up": np.unique(suffixes[first[stays]]).tobytes(), "hot": hot.tobytes()}
        return _table(out, ANSWERED)

    return run


def _longs(names: tuple[str, ...], column: str, carried: str | None = None):
    """Rows of the longs in a binary column, with a column that is carried along."""

    def run(batches):
        for batch in batches:
            blobs = batch.column(column).to_pylist()
            found = [np.frombuffer(b, np.int64).reshape(-1, len(names)) for b in blobs]
            every = np.concatenate([np.zeros((0, len(names)), np.int64), *found])
            columns = [pa.array(np.ascontiguousarray(every[:, i])) for i in range(len(names))]
            if carried:
                columns.append(batch.column(carried).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *([carried] if carried else [])])

    return run


class _Model:
    """What all groups know: tokens, words, training texts, and the contexts with more places than hot."""

    def __init__(self, n: int, v: int, n_texts: int, max_depth: int, least_count: int, least_ratio: float, hot: int) -> None:
        self.n, self.unit, self.n_texts = n, n + 0.1 * (v + 1), n_texts
        self.max_depth, self.least_count, self.least_ratio, self.hot = max_depth, least_count, least_ratio, hot
        self.split: list[np.ndarray] = []  #: by level: sorted structs of HOT, with gain as the ratio

    def candidates(self, seen: np.ndarray, suffix_seen: np.ndarray, level: int) -> np.ndarray:
        """The places whose contexts, of so many places and with suffixes of so many, can diverge or, short of the last level, end one that does."""
        at = np.flatnonzero(seen >= self.least_count)
        own, most = seen[at], 2.0 * np.broadcast_to(suffix_seen, len(seen))[at] + 1
        n = np.maximum(1.0, np.minimum(own, most / np.e))
        bound = n * np.log(most / n)
        if level < self.max_depth:
            bound = np.maximum(bound, (2.0 * own + 1) / np.e)
        return at[bound >= self.least_ratio * (1 - 1e-9)]


def _group(model, depth: int, n_slices: int):
    """Requests of a group for pairs with contexts of depth symbols, or past the last depth its scores, from the answers to all before."""

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        t: _Model = model.value
        group = packed.column("grp")[0].as_py()
        coded = pa.ipc.open_stream(packed.column("docs")[0].as_py()).read_all().to_pylist()[0]
        docs = pa.ipc.open_stream(coded["docs"]).read_all()
        offsets = words.prefix(docs.column("n").to_numpy())
        tokens = _wide(coded["tokens"]).astype(np.int32)
        few = np.int32 if t.n < 1 << 31 else np.int64  # what holds any count
        h, seen = _wide(coded["numbers"])[tokens].view(np.uint64), _wide(coded["counts"]).astype(few)[tokens]
        del tokens
        is_train = docs.column("train").to_numpy(zero_copy_only=False).astype(bool)
        train = np.repeat(is_train, np.diff(offsets))
        said: dict[int, list] = {}
        for row in answers.sort_by("slice").to_pylist():
            said.setdefault(row["level"], []).append(row)
        told = lambda level, name: _joined([_wide(r[name]) for r in said.get(level, []) if r[name] is not None], np.int64)
        n_known = np.add.reduceat((seen > 0).astype(np.int64), offsets[:-1]) if depth > t.max_depth else None
        p = (seen + 0.1) / t.unit
        base = np.add.reduceat(np.log10(p), offsets[:-1]) if depth > t.max_depth else None
        best = p.copy()
        place = np.arange(len(h), dtype=np.int32) - np.repeat(offsets[:-1].astype(np.int32), np.diff(offsets))
        c, before = np.zeros(len(h), np.uint64), np.where(place > 0, np.roll(h, 1), START)
        for level in range(1, t.max_depth + 1):
            suffix_seen = seen if level > 1 else t.n
            if level > 1:
                seen = following
            seen = np.where(place > 0, np.roll(seen, 1), few(t.n_texts if level == 1 else 0))
            suffix, c = c, words.mix(c * _ODD[0] + before + _U(level))
            before = np.where(place > level, np.roll(before, 1), START)
            at = t.candidates(seen, suffix_seen, level)
            asked = _Asked(c[at], h[at], seen[at], t.hot)
            if level == depth:
                return _table(asked.rows(group, c[at], suffix[at], p[at], train[at], n_slices), ASKED)
            own, of = told(level, "counts")[asked.entry_at], told(level, "contexts")[asked.context_at]
            kinds, stays = of >> 1, (of & 1).astype(bool)
            hot = t.split[level - 1]
            if len(hot):
                where = np.minimum(np.searchsorted(hot["c"], c[at]), len(hot) - 1)
                is_hot = hot["c"][where] == c[at]
                kinds, stays = np.where(is_hot, hot["kinds"][where].astype(np.int64), kinds), np.where(is_hot, hot["gain"][where] >= 0, stays)
            for row in said.get(level, []):
                if row["extra"]:
                    stays |= np.isin(c[at], np.array(row["extra"], np.int64).view(np.uint64))
            p[at] = (own + (kinds + 1) * p[at]) / (seen[at] + kinds + 1)
            best[at[stays]] = p[at[stays]]
            following = np.zeros(len(h), few)
            following[at] = own
            del asked, own, of, kinds, stays, at
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": pa.array(~is_train),
            "n_tokens": pa.array(np.diff(offsets)), "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(is_train), t.n, np.int64)), "base_score": pa.array(base), "score": pa.array(np.add.reduceat(np.log10(best), offsets[:-1])),
        })

    return run


def score_texts(docs: DataFrame, train, *, max_depth: int = 3, least_count: int = 3, penalty: float = 3.0, group_bytes: int = 5 << 20, slice_entries: int = 400_000, hot: int = 1 << 20) -> DataFrame:
    """One row a document of (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; train is a condition on docs.

    A null text is empty: its end alone.  Rows that share a doc_id are texts of their own, and a null doc_id is the empty
    string where train looks at it.  Without training texts every score is that of the base.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_bytes, n_texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    groups, n_slices = 1 + n_bytes // group_bytes, int(1 + n_bytes // 30 // slice_entries)
    dealt = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    given = stored(dealt.groupBy("grp").applyInArrow(_word_requests(n_slices), ASKED), "groups")
    packed = given.where("slice = -1").select("grp", "docs")
    numbered = stored(given.where("slice >= 0").groupBy("slice").applyInArrow(_word_answers, ANSWERED), "counts")
    n, v = numbered.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    least_ratio = penalty * np.log(max(2, n))
    model = _Model(n, v, n_texts, max_depth if n else 0, least_count, least_ratio, hot)

    coded = stored(packed.groupBy("grp").cogroup(numbered.groupBy("grp")).applyInArrow(_coded(n_slices), CODED), "coded")
    dropped(given, numbered)
    answers: list[DataFrame] = []

    def asked(depth: int, extra: list[DataFrame], slices: int, ddl: str) -> DataFrame:
        every = spark.createDataFrame([], "grp long, level int, slice long, counts binary, contexts binary, extra array<long>")
        for level, a in enumerate(answers, 1):
            rows = a.select("grp", F.lit(level).alias("level"), "slice", "counts", "contexts", F.lit(None).cast("array<long>").alias("extra"))
            every = every.unionByName(rows)
        for e in extra:
            every = every.unionByName(e, allowMissingColumns=True)
        return coded.groupBy("grp").cogroup(every.groupBy("grp")).applyInArrow(_group(spark.sparkContext.broadcast(model), depth, slices), ddl)

    ups: list[DataFrame] = []
    for depth in range(1, model.max_depth + 1):
        slices = int(1 + n_bytes // 15 // slice_entries)
        found = stored(asked(depth, [], slices, ASKED).groupBy("slice").applyInArrow(_pair_answers(least_ratio), ANSWERED), "pairs")
        answers.append(found)
        parts = _joined([np.frombuffer(r.hot, HOT) for r in found.where("length(hot) > 0").select("hot").collect()], HOT)
        names, first, inverse = np.unique(parts["c"], return_index=True, return_inverse=True)
        split = np.zeros(len(names), HOT)
        split["c"], split["suffix"] = names, parts["suffix"][first]
        for name in ("n", "kinds", "gain"):
            split[name] = np.bincount(inverse, weights=parts[name], minlength=len(names))
        split["gain"] -= split["n"] * np.log(np.maximum(split["n"], 1)) + least_ratio
        model.split.append(split)
        up = found.where("up IS NOT NULL").select("up").mapInArrow(_longs(("c",), "up"), "c long")
        stay = split["suffix"][split["gain"] >= 0].view(np.int64).tolist()
        ups.append(up.unionByName(spark.createDataFrame([(c,) for c in stay], "c long")) if stay else up)
    extra: list[DataFrame] = []
    for depth in range(model.max_depth - 1, 0, -1):
        asks = answers[depth - 1].select("grp", "asks").mapInArrow(_longs(("c", "suffix"), "asks", "grp"), "c long, suffix long, grp long")
        more = stored(asks.join(ups[depth].distinct(), "c", "left_semi"), "suffixes")
        extra.append(more.groupBy("grp").agg(F.collect_set("c").alias("extra")).withColumns({"level": F.lit(depth), "slice": F.lit(-1).cast("long")}))
        ups[depth - 1] = ups[depth - 1].unionByName(more.select(F.col("suffix").alias("c")))
    return asked(model.max_depth + 1, extra, 1, SCORED)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, remainder(10) != 0)
