"""BPE encoding and decoding through a lexicon of frequent words.

1. Every text is normalised and cut as the tokenizer file says (NFC, lower case, words,
   single digits, other signs), and the words of all texts are counted.
2. The most frequent ones are merged once and compiled into a minimal acyclic
   transducer: states with the same continuations and outputs are one, and ids stand on
   the first arc from which they are sure.  It is laid out as arrays in one file in the
   shared folder, which Spark brings to each executor and each task maps into memory.
3. All words of a chunk of texts walk through it together, a byte a step.  Words that it
   doesn't hold are merged exactly, pair by pair in the order of the file's ranks.

How many words the lexicon holds changes the speed only.  Decoding joins the tokens
of the ids by spaces, as the file names no decoder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.scratch import dropped, fresh_path, stored
from dossier.llm.words import prefix

SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
CHUNK = 2 << 20  #: characters of texts that are encoded at a time
LONG_WORD = 48  #: symbols from which a word's pairs wait in a heap
MOST_CACHED = 1 << 19  #: unseen words of which a task keeps the ids
#: The normaliser and the cuts of the tokenizer files that this module reads.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_symbols() -> list[str]:
    """The letter that stands for each byte: itself where it is printable in Latin-1, else the next one from 256 on."""
    out, other = [], 256
    for b in range(256):
        printable = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b
        out.append(chr(b if printable else other))
        other += not printable
    return out


@dataclass
class Vocabulary:
    """A BPE tokenizer file with a suffix for the ends of words."""

    tokens: dict[int, str]
    special: dict[str, int]
    first: list[int | None]  #: the id of each byte inside a word
    last: list[int | None]  #: and at its end
    pairs: dict[int, tuple[int, int]]  #: left id << 32 | right id -> rank and id of what they merge to

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        plain = not (model.get("continuing_subword_prefix") or model.get("unk_token") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] != NORMALIZER or pre[0]["pattern"] != {"Regex": CUTS} or spec["decoder"] is not None:
            raise ValueError(f"{path} is no tokenizer file of the kind that is read here")
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pairs[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
        letters = byte_symbols()
        return cls({i: t for t, i in (ids | added).items()}, added, [ids.get(c) for c in letters], [ids.get(c + suffix) for c in letters], pairs)

    def merged(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word: of all neighbours with a rank the lowest, leftmost pair merges, until none is left."""
        ids = [i for i in (*(self.first[b] for b in word[:-1]), self.last[word[-1]]) if i is not None]
        return self._by_heap(ids) if len(ids) > LONG_WORD else self._by_scan(ids)

    def _by_scan(self, ids: list[int]) -> tuple[int, ...]:
        get = self.pairs.get
        found = [get(a << 32 | b) for a, b in zip(ids, ids[1:], strict=False)]
        while any(found):
            at = min((f[0], i) for i, f in enumerate(found) if f)[1]
            ids[at : at + 2] = [found[at][1]]
            del found[at]
            if at:
                found[at - 1] = get(ids[at - 1] << 32 | ids[at])
            if at < len(found):
                found[at] = get(ids[at] << 32 | ids[at + 1])
        return tuple(ids)

    def _by_heap(self, ids: list[int]) -> tuple[int, ...]:
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        waiting: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b >= 0 and (found := self.pairs.get(ids[a] << 32 | ids[b])):
                heapq.heappush(waiting, (found[0], a, found[1]))

        for a in range(n - 1):
            offer(a)
        while waiting:
            rank, a, new = heapq.heappop(waiting)
            if ids[a] < 0 or (b := after[a]) < 0 or self.pairs.get(ids[a] << 32 | ids[b]) != (rank, new):
                continue
            ids[a], ids[b] = new, -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return tuple(i for i in ids if i >= 0)


@dataclass
class Cutter:
    """Normalises texts and cuts them into words."""

    kinds: np.ndarray  #: of each code point
    lower: dict[int, str]  #: lower case where it isn't Python's
    special: dict[str, str]  #: special tokens and the surrogates that stand for them in a normalised text
    odd: re.Pattern | None = None

    @classmethod
    def make(cls, vocabulary: Vocabulary) -> Cutter:
        """Classes and case come from the tokenizers library's own Unicode tables, whichever version they are of."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        kinds = np.full(0x110000, OTHER, dtype=np.uint8)
        everything = "".join(map(chr, points))
        for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            found = pre_tokenizers.Split(Regex(pattern + "+"), "removed", invert=True).pre_tokenize_str(everything)
            kinds[np.frombuffer("".join(t for t, _ in found).encode("utf-32-le"), np.uint32)] = kind
        lowered = normalizers.Lowercase().normalize_str("\n".join(chr(c) for c in points if c != 10)).split("\n")
        lower = {c: x for c, x in zip((c for c in points if c != 10), lowered, strict=True) if chr(c).lower() != x} | {0x3A3: chr(0x3C3)}  # a sigma is one wherever it stands
        special = {t: chr(0xD800 + k) for k, t in enumerate(sorted(vocabulary.special))}
        kinds[0xD800 : 0xD800 + len(special)] = SPECIAL
        return cls(kinds, lower, special, re.compile("[" + "".join(map(chr, lower)) + "]"))

    def normal(self, text: str) -> str:
        for token, mark in self.special.items():
            if token in text:
                text = text.replace(token, mark)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if self.odd.search(text):
                text = text.translate(self.lower)
        return text.lower()

    def pieces(self, text: str) -> Iterator[str]:
        """A text in parts of about CHUNK characters that begin at white space or an ASCII digit, where nothing joins; a longer run without these is one part."""
        at = 0
        while len(text) - at > 2 * CHUNK:
            cut = re.compile(r"[\x09-\x0d 0-9]").search(text, at + CHUNK)
            if cut is None:
                break
            yield self.normal(text[at : cut.start()])
            at = cut.start()
        yield self.normal(text[at:])

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of a normalised text, byte offsets of its words' starts and ends, and the code points at which they start."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = len(points)
        kind = self.kinds[points]
        start = np.ones(n, dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == SPECIAL)
        start &= kind != SPACE
        at = np.flatnonzero((points == 0x27) & start)
        at = at[at + 1 < n]
        if len(at):
            one, two = points[at + 1], points[np.minimum(at + 2, n - 1)]
            two = np.where(at + 2 < n, two, 0)
            letter = lambda x, c: x == ord(c)
            short = letter(one, "s") | letter(one, "t") | letter(one, "m") | letter(one, "d")
            longer = (letter(one, "r") | letter(one, "v")) & letter(two, "e") | letter(one, "l") & letter(two, "l")
            size = np.where(short, 2, np.where(longer, 3, 0))
            at, size = at[size > 0], size[size > 0]
            start[at + 1] = False
            rest = (at + size)[at + size < n]
            start[rest[kind[rest] == LETTER]] = True
        inside = kind != SPACE
        end = inside.copy()
        end[:-1] &= start[1:] | ~inside[1:]
        begins, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        if len(data) == n:
            return data, begins, ends, begins
        offsets = prefix((1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64))
        return data, offsets[begins], offsets[ends], begins


@dataclass
class _State:
    arcs: dict[int, list] = field(default_factory=dict)  #: byte -> target, ids
    final: tuple[int, ...] | None = None  #: ids at the end of a word that ends here


def _common(a: tuple, b: tuple) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def transducer(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> list[tuple[tuple[int, ...] | None, list[tuple[int, int, tuple[int, ...]]]]]:
    """The minimal acyclic transducer of words in byte order with their ids: per state its final ids and arcs (byte, target, ids); the last is the first."""
    states: list = []
    known: dict = {}

    def settled(state: _State) -> int:
        arcs = [(b, t, o) for b, (t, o) in sorted(state.arcs.items())]
        key = (state.final, tuple(arcs))
        if key not in known:
            known[key] = len(states)
            states.append((state.final, arcs))
        return known[key]

    path, previous = [_State()], b""
    for word, ids in entries:
        shared = 0
        while shared < min(len(previous), len(word)) and previous[shared] == word[shared]:
            shared += 1
        for i in range(len(previous), shared, -1):
            path[i - 1].arcs[previous[i - 1]][0] = settled(path[i])
        del path[shared + 1 :]
        for byte in word[shared:]:
            new = _State()
            path[-1].arcs[byte] = [new, ()]
            path.append(new)
        path[-1].final = ()
        for i in range(shared):
            arc = path[i].arcs[word[i]]
            n = _common(arc[1], ids)
            held, below = arc[1][n:], path[i + 1]
            if held:  # moves on to all that follows
                for further in below.arcs.values():
                    further[1] = held + further[1]
                if below.final is not None:
                    below.final = held + below.final
            arc[1], ids = arc[1][:n], ids[n:]
        if len(word) > shared:
            path[shared].arcs[word[shared]][1] = ids
        else:
            path[-1].final = ids
        previous = word
    for i in range(len(previous), 0, -1):
        path[i - 1].arcs[previous[i - 1]][0] = settled(path[i])
    settled(path[0])
    return states


class Lexicon:
    """A transducer as arrays: the arc of state s for byte b stands at base[s] + b, if owner says so."""

    NAMES = ("base", "final_at", "final_n", "owner", "target", "out_at", "out_n", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.root = len(arrays["base"]) - 1
        self.__dict__ |= arrays

    @classmethod
    def compiled(cls, entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> Lexicon:
        states = transducer(entries)
        pool: dict[tuple[int, ...], int] = {}
        ids: list[int] = []

        def place(out: tuple[int, ...]) -> int:
            if out not in pool:
                pool[out] = len(ids)
                ids.extend(out)
            return pool[out]

        n_arcs = sum(len(arcs) for _, arcs in states)
        taken = bytearray(2 * n_arcs + 1024)
        slots: list[tuple[int, int, int, int, int]] = []
        base = np.zeros(len(states), dtype=np.int32)
        from_size: dict[int, int] = {}
        for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
            arcs = states[s][1]
            if not arcs:
                continue
            at = from_size.get(len(arcs), 256)
            while True:
                if at + 512 > len(taken):
                    taken.extend(bytes(len(taken)))
                at = taken.index(0, at)
                if not any(taken[at - arcs[0][0] + b] for b, _, _ in arcs):
                    break
                at += 1
            from_size[len(arcs)] = at
            base[s] = at - arcs[0][0]
            for b, target, out in arcs:
                taken[base[s] + b] = 1
                slots.append((base[s] + b, s, target, place(out), len(out)))
        final = [(-1, 0) if f is None else (place(f), len(f)) for f, _ in states]
        size = max((x[0] for x in slots), default=0) + 512
        table = np.zeros((4, size), dtype=np.int32)
        table[0] = -1
        if slots:
            where, *values = np.array(slots, dtype=np.int32).T
            table[:, where] = values
        arrays = [base, *np.array(final, dtype=np.int32).reshape(-1, 2).T, *table, np.array([*ids, 0], dtype=np.int32)]
        return cls(dict(zip(cls.NAMES, arrays, strict=True)))

    def to_bytes(self) -> bytes:
        sizes = np.array([len(getattr(self, n)) for n in self.NAMES], dtype=np.int32)
        return b"".join([sizes.tobytes(), *(np.ascontiguousarray(getattr(self, n), dtype=np.int32).tobytes() for n in self.NAMES)])

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        whole = np.memmap(path, dtype=np.int32, mode="r")
        ends = prefix(whole[: len(cls.NAMES)].astype(np.int64)) + len(cls.NAMES)
        return cls({n: whole[a:b] for n, a, b in zip(cls.NAMES, ends[:-1].tolist(), ends[1:].tolist(), strict=True)})

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words it holds, how many ids each of these has (0 for others), and all of them in order."""
        n = len(starts)
        held, total = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        word, state, step = np.arange(n), np.full(n, self.root, dtype=np.int32), 0
        sizes = ends - starts
        told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            over = sizes[word] == step
            if over.any():
                w, s = word[over], state[over]
                w, s = w[good := self.final_at[s] >= 0], s[good]
                held[w] = True
                told.append((w, self.final_at[s], self.final_n[s]))
                word, state = word[~over], state[~over]
            slot = self.base[state] + data[starts[word] + step]
            hit = self.owner[slot] == state
            word, slot = word[hit], slot[hit]
            out = self.out_n[slot]
            says = out > 0
            told.append((word[says], self.out_at[slot[says]], out[says]))
            state, step = self.target[slot], step + 1
        if not told:
            return held, total, np.zeros(0, np.int32)
        w, at, many = (np.concatenate(x) for x in zip(*told, strict=True))
        own = held[w] & (many > 0)
        order = np.argsort(w[own], kind="stable")
        w, at, many = w[own][order], at[own][order].astype(np.int64), many[own][order].astype(np.int64)
        np.add.at(total, w, many)
        return held, total, self.ids[np.repeat(at - prefix(many)[:-1], many) + np.arange(int(many.sum()))]


@dataclass
class _Encoder:
    vocabulary: Vocabulary
    cutter: Cutter
    lexicon: Lexicon
    cache: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.fixed = {mark.encode("utf-8", "surrogatepass"): (self.vocabulary.special[t],) for t, mark in self.cutter.special.items()}
        self.cache.update(self.fixed)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of normalised texts one after the other, and where each text's begin (one place more than there are texts)."""
        joined = "\n".join(parts)
        data, starts, ends, points = self.cutter.words(joined)
        held, total, ids = self.lexicon.walk(data, starts, ends)
        unseen = np.flatnonzero(~held)
        if len(unseen):
            raw, known = data.tobytes(), self.cache
            found = []
            for a, b in zip(starts[unseen].tolist(), ends[unseen].tolist(), strict=True):
                word = raw[a:b]
                own = known.get(word)
                if own is None:
                    own = self.vocabulary.merged(word)
                    if len(word) <= 64:
                        if len(known) >= MOST_CACHED:
                            known.clear()
                            known.update(self.fixed)
                        known[word] = own
                found.append(own)
            total[unseen] = [len(x) for x in found]
            out = np.zeros(int(total.sum()), dtype=np.int32)
            theirs = np.repeat(~held, total)
            out[theirs] = np.array([i for x in found for i in x], dtype=np.int32)
            out[~theirs] = ids
            ids = out
        texts = prefix(np.array([len(p) + 1 for p in parts], dtype=np.int64))
        return ids, prefix(total)[np.searchsorted(points, texts)]


def _encoded(shared, name: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cutter = shared.value
        encoder = _Encoder(vocabulary, cutter, Lexicon.mapped(SparkFiles.get(name)))
        spelled = {i: t.encode() for i, t in vocabulary.tokens.items()}
        spelled_as = np.array([spelled.get(i, b"") for i in range(max(spelled) + 1)], dtype=object)
        number_as = np.array([str(i).encode() for i in range(max(spelled) + 1)], dtype=object)
        for batch in batches:
            texts = batch.column("text")
            n = batch.num_rows
            many = [0] * n
            hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in range(n)]
            kept: list[list[np.ndarray]] = [[] for _ in range(n)]
            parts: list[str] = []
            rows: list[int] = []

            def flush(parts=parts, rows=rows, many=many, hashes=hashes, kept=kept) -> None:
                ids, cuts = encoder.encode(parts)
                numbers, tokens = number_as[ids].tolist(), spelled_as[ids].tolist()
                for row, a, b in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if b > a:
                        for sha, words in zip(hashes[row], (numbers, tokens), strict=True):
                            sha.update((b" " if many[row] else b"") + b" ".join(words[a:b]))
                        many[row] += b - a
                        if with_ids:
                            kept[row].append(ids[a:b])
                parts.clear()
                rows.clear()

            size = 0
            for row in range(n):
                text = texts[row].as_py()
                for part in cutter.pieces(text) if text else ():
                    parts.append(part)
                    rows.append(row)
                    size += len(part)
                    if size >= CHUNK:
                        flush()
                        size = 0
            if parts:
                flush()
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(many, pa.int64()), "ids_sha256": pa.array([a.hexdigest() for a, _ in hashes]), "decoded_sha256": pa.array([b.hexdigest() for _, b in hashes])}
            if with_ids:
                out["ids"] = pa.array([np.concatenate([np.zeros(0, np.int32), *own]) for own in kept], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _counted(shared):
    """The distinct words of some texts and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cutter = shared.value

        def counted(parts: list[str]) -> pa.RecordBatch:
            data, starts, ends, _ = cutter.words("\n".join(parts))
            inside = np.zeros(len(data) + 1, dtype=np.int8)
            inside[starts] = 1
            np.add.at(inside, ends, -1)
            spelled = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(prefix(ends - starts)), pa.py_buffer(spelled)]).dictionary_encode()
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            return pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

        parts, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                for part in cutter.pieces(text.as_py()) if text.is_valid else ():
                    parts.append(part)
                    size += len(part)
                    if size >= 4 * CHUNK:
                        yield counted(parts)
                        parts, size = [], 0
        if parts:
            yield counted(parts)

    return run


def _merged_words(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cutter = shared.value
        marks = {m.encode("utf-8", "surrogatepass") for m in cutter.special.values()}
        for batch in batches:
            words = [w for w in batch.column("word").to_pylist() if w not in marks]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([vocabulary.merged(w) for w in words], pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _shipped(spark: SparkSession, data: bytes) -> str:
    """Writes a file to the shared folder and lets Spark bring it to each executor; its name there."""
    path = fresh_path(spark, "lexicon")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encoded(docs: DataFrame, tokenizer: str, *, most_words: int = 1 << 16, with_ids: bool = False) -> DataFrame:
    """One row a document of (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array of int) if asked for.

    tokenizer: path of a tokenizer file, read on the driver.  The strings of its special tokens are these tokens wherever
    they stand.  Null and empty texts have no ids; repeated rows are rows of their own; an empty table gives none; other
    columns are ignored.  most_words: the lexicon holds the words of the highest levels of frequency that are no more than
    that together.  A long text is encoded in
    parts of some million characters, cut at white space or digits; what has neither is one part and takes some 60 bytes
    of a task's memory a character.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = Vocabulary.read(tokenizer)
    shared = spark.sparkContext.broadcast((vocabulary, Cutter.make(vocabulary)))
    counts = docs.select("text").mapInArrow(_counted(shared), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.where("n > 1").withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "words")
    room, least = most_words, None
    for level in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # 1024 rows at most
        room -= level["n"]
        if room < 0:
            break
        least = level["level"]
    frequent = counts.where(F.col("level") >= least) if least is not None else counts.limit(0)
    entries = frequent.select("word").mapInArrow(_merged_words(shared), "word binary, ids array<int>").collect()  # most_words rows at most
    dropped(counts)
    lexicon = Lexicon.compiled(sorted((bytes(r["word"]), tuple(r["ids"])) for r in entries))
    name = _shipped(spark, lexicon.to_bytes())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.mapInArrow(_encoded(shared, name, with_ids), schema)


def decoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text): the tokens joined by spaces; ids that are none are left out, null ids give a null text."""
    spelled = rows.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = spelled.value
        for batch in batches:
            texts = [None if ids is None else " ".join(tokens[i] for i in ids if i in tokens) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op13_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer)
