"""Benchmark decontamination by a BM25 index of test items with block-max WAND.

The test items are the indexed documents and every passage of the training texts
is a query.  An item's weights are divided by its score against itself, so that
one threshold asks for the same share of any item.  Postings lie in blocks of
items with the largest weight of each term in each block.  An item's rarest terms
make up most of its score, so that it must have something from these; where the sum
of a block's maxima over a passage's leading terms shows that, the sum over all its
terms bounds the scores, and passages that no block admits are gone.  The others run
block-max WAND over the admitted blocks and retrieve every item above the threshold.
The index takes a few numbers a posting, and work arrays are of bounded size.  What is
retrieved is verified: both the item's question and its answer must be found in
order, word by word, around the passage.

Items go by length into classes, each with passages of its own length, so that any
run of words as long as an item lies whole in some passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import words

K1, B = 1.2, 0.75
BLOCK = 8
LEADING = 0.75
MOST, PAIRS = 1 << 21, 1 << 12  #: cells times blocks, and passages with a block, that are looked at at a time
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_U = np.uint64


def terms(chunk: words.Chunk) -> tuple[list[np.ndarray], np.ndarray]:
    """Both hashes of the words without case and without ASCII punctuation at their ends, and the documents' offsets; words of punctuation alone are left out."""
    data = words.LOWER[chunk.data]
    if len(data) > 1:  # capitals of Latin-1: C3 80 to C3 9E, but for the multiplication sign
        capital = np.zeros(len(data), dtype=bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = data + capital.astype(np.uint8) * 32
    mark = PUNCTUATION[data]
    starts, ends = chunk.starts.copy(), chunk.ends.copy()
    # the first and last byte that is no punctuation, for each word
    plain = words.prefix((~mark).astype(np.int64))
    keep = plain[ends] > plain[starts]
    starts, ends = starts[keep], ends[keep]
    places = np.flatnonzero(~mark)
    starts, ends = places[plain[starts]], places[plain[ends] - 1] + 1
    clean = words.Chunk(chunk.first, data, chunk.doc_bytes, starts, ends, np.searchsorted(starts, chunk.doc_bytes))
    return clean.both_hashes(), clean.doc_words


@dataclass
class _Postings:
    """The items of each term and their weights."""

    starts: np.ndarray
    item: np.ndarray
    weight: np.ndarray

    def __getitem__(self, t: int) -> tuple[list[int], list[float]]:
        part = slice(self.starts[t], self.starts[t + 1])
        return self.item[part].tolist(), self.weight[part].tolist()


@dataclass
class _Item:
    item_id: int
    sequence: np.ndarray  #: first hashes of its words
    second: np.ndarray
    split: int  #: words before it are the question, the others the answer


class ItemIndex:
    """Inverted index of items whose lengths lie in one class: sparse, a few numbers a posting."""

    def __init__(self, items: list[_Item], threshold: float) -> None:
        self.items, self.threshold = items, threshold
        self.length = max(len(i.sequence) for i in items)
        n, lengths = len(items), np.array([len(i.sequence) for i in items])
        item = np.repeat(np.arange(n), lengths)
        words_, tf = np.unique(np.stack([np.concatenate([i.sequence for i in items]), item.astype(np.uint64)], axis=1), axis=0, return_counts=True)  # by term, then item
        self.vocabulary, term, df = np.unique(words_[:, 0], return_inverse=True, return_counts=True)
        item = words_[:, 1].astype(np.int64)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / lengths.mean()))
        w = w / np.bincount(item, weights=w, minlength=n)[item]
        self.n_blocks = -(-n // BLOCK)
        self.starts = np.append(0, np.cumsum(df))  #: of each term's postings
        self.postings = _Postings(self.starts, item.astype(np.int32), w)
        # the largest weight of each term in each block that has it
        block = item // BLOCK
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
        self.block_of, self.block_weight = block[first].astype(np.int32), np.maximum.reduceat(w, first).astype(np.float32)
        self.block_starts = np.searchsorted(term[first], np.arange(len(df) + 1))
        self.block_keys = term[first] * self.n_blocks + block[first]
        self.term_max = np.maximum.reduceat(w, self.starts[:-1])
        # of each item the rarest terms that make up LEADING of its score: an item above the threshold has the rest from these
        rare = np.lexsort((term, df[term], item))
        sizes = np.bincount(item, minlength=n)
        done = np.cumsum(w[rare])
        done -= np.repeat(np.append(0, done[np.cumsum(sizes)[:-1] - 1]), sizes)
        leads = done - w[rare] <= LEADING
        other = np.bincount(item[rare], weights=np.where(leads, 0, w[rare]), minlength=n)
        self.needed = np.minimum.reduceat(threshold - other, np.arange(0, n, BLOCK)) - 1e-4  #: of each block what its leading terms must sum up to
        leading = np.zeros(len(w), dtype=bool)
        leading[rare[leads]] = True
        entries = np.flatnonzero(np.logical_or.reduceat(leading, first))  # of blocks and terms
        self.lead_block, self.lead_weight = self.block_of[entries], self.block_weight[entries].astype(np.float64)
        self.lead_starts = np.searchsorted(term[first][entries], np.arange(len(df) + 1))
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.vocabulary >> _U(44)).astype(np.int64)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Term numbers; len(vocabulary) for words outside."""
        out = np.full(len(h), len(self.vocabulary), dtype=np.int64)
        maybe = np.flatnonzero(self.seen[(h >> _U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == h[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def block_bounds(self, terms: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The largest weight of each term in the block beside it; 0 where the block lacks it."""
        keys = terms * self.n_blocks + blocks
        at = np.minimum(np.searchsorted(self.block_keys, keys), len(self.block_keys) - 1)
        return np.where(self.block_keys[at] == keys, self.block_weight[at], np.float32(0))

    def retrieve(self, query: list[int], admitted: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: items of the admitted blocks with a score of at least the threshold, by item number."""
        lists, limits = [], []
        for t in query:
            part = slice(self.block_starts[t], self.block_starts[t + 1])
            lists.append((*self.postings[t], float(self.term_max[t])))
            limits.append(dict(zip(self.block_of[part].tolist(), self.block_weight[part].tolist(), strict=True)))
        at = [0] * len(lists)
        found = []
        while True:
            order = sorted((k for k in range(len(lists)) if at[k] < len(lists[k][0])), key=lambda k: lists[k][0][at[k]])
            total, pivot = 0.0, None
            for n, k in enumerate(order):
                total += lists[k][2]
                if total >= self.threshold - 1e-6:
                    pivot = n
                    break
            if pivot is None:
                return found
            item = lists[order[pivot]][0][at[order[pivot]]]
            while pivot + 1 < len(order) and lists[order[pivot + 1]][0][at[order[pivot + 1]]] == item:
                pivot += 1
            block = item // BLOCK
            bound = sum(limits[k].get(block, 0.0) for k in order[: pivot + 1])
            if admitted[block] and bound >= self.threshold - 1e-6:
                if lists[order[0]][0][at[order[0]]] == item:
                    score = 0.0
                    for k in order[: pivot + 1]:
                        score += lists[k][1][at[k]]
                        at[k] += 1
                    if score >= self.threshold - 1e-9:
                        found.append((item, score))
                else:
                    for k in order[:pivot]:
                        _advance(lists[k][0], at, k, item)
            else:  # nothing before the end of the block, or before the next list's item, can pass
                end = (block + 1) * BLOCK
                if pivot + 1 < len(order):
                    end = min(end, lists[order[pivot + 1]][0][at[order[pivot + 1]]])
                for k in order[: pivot + 1]:
                    _advance(lists[k][0], at, k, max(end, item + 1))

    def passages(self, doc_words: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(document, first word, end, terms, admitted blocks) of each passage that some block admits.

        Cells of half an item's length tile a document, and three in a row are a passage.
        """
        cell = max(1, -(-self.length // 2))
        counts = -(-np.diff(doc_words) // cell)
        doc = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)  # of a cell in its document
        start = doc_words[doc] + inner * cell
        after = np.arange(len(doc)) - inner + counts[doc]  # the first cell past the document
        # one that starts inside the passage before and ends with it adds nothing
        passage = (inner == 0) | (inner <= counts[doc] - 3)
        place = np.flatnonzero(numbers < len(self.vocabulary))
        of_word = np.searchsorted(start, place, side="right") - 1
        in_cell, term = np.divmod(np.unique(of_word * len(self.vocabulary) + numbers[place]), len(self.vocabulary))  # each term once a cell
        cuts = np.searchsorted(in_cell, np.arange(len(doc) + 1))
        step = max(1, MOST // self.n_blocks)
        for a in range(0, len(doc), step):
            b = min(len(doc), a + step + 2)
            sums = self._lead_sums(in_cell[cuts[a] : cuts[b]] - a, term[cuts[a] : cuts[b]], b - a)
            bound = sums.copy()
            for k in (1, 2):
                bound[:-k] += sums[k:] * (doc[a + k : b] == doc[a : b - k])[:, None]
            first, block = np.nonzero((bound[:step] >= self.needed) & passage[a : min(b, a + step), None])
            for k in range(0, len(first), PAIRS):
                p, q = first[k : k + PAIRS] + a, block[k : k + PAIRS]
                low, high = cuts[p], cuts[np.minimum(p + 3, after[p])]
                n = high - low
                entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                of, t = np.divmod(np.unique(np.repeat(np.arange(len(p)), n) * len(self.vocabulary) + term[entry]), len(self.vocabulary))
                good = np.bincount(of, weights=self.block_bounds(t, q[of]), minlength=len(p)) >= self.threshold - 1e-4
                for x in np.unique(p[good]):
                    admitted = np.zeros(self.n_blocks, dtype=bool)
                    admitted[q[good & (p == x)]] = True
                    yield int(doc[x]), int(start[x]), int(min(start[x] + 3 * cell, doc_words[doc[x] + 1])), np.unique(term[cuts[x] : cuts[min(x + 3, after[x])]]), admitted

    def _lead_sums(self, cell: np.ndarray, term: np.ndarray, n_cells: int) -> np.ndarray:
        """For each cell and block the sum of the largest weights of the cell's leading terms."""
        low, n = self.lead_starts[term], np.diff(self.lead_starts)[term]
        some = n > 0
        cell, low, n = cell[some], low[some], n[some]
        sums = np.zeros(n_cells * self.n_blocks)
        done = np.cumsum(n)
        for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(done // MOST)) + 1):
            few = n[cut]
            entry = np.repeat(low[cut] - (np.cumsum(few) - few), few) + np.arange(few.sum())
            sums += np.bincount(np.repeat(cell[cut], few) * self.n_blocks + self.lead_block[entry], weights=self.lead_weight[entry], minlength=len(sums))
        return sums.reshape(n_cells, self.n_blocks)


def _advance(items: list[int], at: list[int], k: int, to: int) -> None:
    n = at[k]
    while n < len(items) and items[n] < to:
        n += 1
    at[k] = n


def common_words(a: list, b: list) -> int:
    """Length of the longest common subsequence, by a row of bits a word of b."""
    where: dict = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for x in b:
        if m := where.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _split(text: str) -> int:
    """Where the answer begins: after the last question mark or line break with words on both sides, else at the last third of the words."""
    for mark in ("?", "\n"):
        head, found, tail = text.rpartition(mark)
        if found and head.split() and tail.split():
            return len(head)
    starts = [m.start() for m in re.finditer(r"\S+", text)]
    return starts[len(starts) - max(1, len(starts) // 3)] if len(starts) > 1 else 0


def build_indexes(items: list[tuple[int, str | None]], threshold: float) -> list[ItemIndex]:
    """Indexes of the items with words, by classes of length that double."""
    texts = [text or "" for _, text in items]
    cut = [_split(text) for text in texts]
    sequences = [[x[a:b] for x in h] for h, d in map(terms, words.chunks(pa.array(texts, pa.string()))) for a, b in zip(d[:-1], d[1:], strict=True)]
    heads = [int(n) for _, d in map(terms, words.chunks(pa.array([t[:c] for t, c in zip(texts, cut, strict=True)], pa.string()))) for n in np.diff(d)]
    classes: dict[int, list[_Item]] = {}
    for (item_id, _), h, head in zip(items, sequences, heads, strict=True):
        if n := len(h[0]):
            classes.setdefault(max(5, (n - 1).bit_length()), []).append(_Item(item_id, *h, min(head, n)))
    return [ItemIndex(c, threshold) for _, c in sorted(classes.items())]


def _matches(indexes: list[ItemIndex], chunk: words.Chunk, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(document, item_id, score, question overlap, answer overlap), the best passage for each document and item."""
    h, doc_words = terms(chunk)
    for index in indexes:
        numbers = index.numbers(h[0])
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for doc, a, b, query, admitted in index.passages(doc_words, numbers):
            for k, score in index.retrieve(query.tolist(), admitted):
                item = index.items[k]
                margin = len(item.sequence)
                part = slice(max(doc_words[doc], a - margin), min(doc_words[doc + 1], b + margin))
                around = [*zip(h[0][part].tolist(), h[1][part].tolist(), strict=True)]
                every = [*zip(item.sequence.tolist(), item.second.tolist(), strict=True)]
                parts = every[: item.split], every[item.split :]
                question, answer = (common_words(p, around) / len(p) if len(p) else 1.0 for p in parts)
                if question >= overlap and answer >= overlap:
                    best[doc, item.item_id] = max(best.get((doc, item.item_id), (0.0, 0.0, 0.0)), (score, question, answer))
        for (doc, item_id), (score, question, answer) in best.items():
            yield doc, item_id, score, question, answer


def _item_blocks(items: DataFrame, threshold: float, most_bytes: int) -> Iterator[list[ItemIndex]]:
    """Indexes of about most_bytes of item text at a time: the driver and the tasks hold one block of items, whatever their number."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // most_bytes
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield build_indexes(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), threshold)


def contaminated_pairs(docs: DataFrame, items: DataFrame, *, threshold: float = 0.6, overlap: float = 0.8, most_index_bytes: int = 16 << 20) -> DataFrame:
    """One row for each row of (doc_id, text) and item of (item_id, text) that it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    score is BM25 as a share of the item's own.  Null and empty texts hold nothing, and such items are nowhere.  Rows that
    share a doc_id or item_id count each for itself.  Words are compared without case and outer punctuation.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for indexes in _item_blocks(items, threshold, most_index_bytes):
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                for chunk in words.chunks(batch.column("text")):
                    rows = list(_matches(shared.value, chunk, overlap))
                    if rows:
                        doc, *others = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([chunk.first + d for d in doc])), *(pa.array(x, f.type) for x, f in zip(others, list(schema)[1:], strict=True))], schema=schema)

        part = docs.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, *, threshold: float = 0.6, overlap: float = 0.8, most_index_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs that hold no item; all columns as they are.

    Null and empty texts hold nothing, and null and empty items are nowhere; repeated rows are judged alike; no rows give none.
    """
    names = docs.columns
    plain = docs.toDF(*[c if c == "text" else f"given_{i}" for i, c in enumerate(names)])
    for indexes in _item_blocks(items, threshold, most_index_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for chunk in words.chunks(batch.column("text")):
                    for doc, *_ in _matches(shared.value, chunk, overlap):
                        keep[chunk.first + doc] = False
                yield batch.filter(pa.array(keep))

        plain = plain.mapInArrow(run, plain.schema)
    return plain.toDF(*names)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated_pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
