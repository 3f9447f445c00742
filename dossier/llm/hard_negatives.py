"""Hard negatives by bounds along spanning trees of the anchors.

Anchors are taken in blocks of bounded size, each of which all rows pass once for the
anchors' positives and once for their negatives.  A block's anchors are linked into a
minimum spanning tree.  A row's score at an anchor differs from that at the parent
anchor by no more than the length of the edge times the row's norm, so that bounds
pass down the tree; only rows whose bounds overlap what is still wanted at an anchor
(above its last positive, or inside the windows of its positives) are rescored there,
exactly.  Where that is a large part of the rows, all are, and the bounds below are
tight again.

Children with small subtrees come first and a parent's bounds go with its last child,
so that a task holds the bounds of a logarithmic number of anchors.  Each task sends a
few rows for each anchor, and the rows of all tasks are ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.scratch import fresh_path, stored

EXACT = 1 << 53  #: below it sums of products of doubles are exact
MOST_NORM = float(1 << 62)  #: squared norms from which scores could leave a long
NO_ID = np.iinfo(np.int64).max  #: a null vec_id, after all others among equals
RESCORE_ALL = 0.25
FOUND = "anchor long, place int, anchor_id long, positive_id long, positive_score long, score long, id long, row long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Tree:
    """A minimum spanning tree in the order in which it is walked; numbers are places in that order."""

    vectors: np.ndarray
    parent: np.ndarray  #: -1 for the first
    edge: np.ndarray
    last: np.ndarray  #: whether a node is its parent's last child

    @classmethod
    def of(cls, vectors: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and which row of vectors each node is."""
        n = len(vectors)
        x = vectors.astype(np.float64)
        squares = (x * x).sum(axis=1)
        near, link = np.full(n, np.inf), np.full(n, -1)
        left = np.ones(n, dtype=bool)
        children: list[list[int]] = [[] for _ in range(n)]
        joined = []
        node = 0
        for _ in range(n):
            left[node] = False
            joined.append(node)
            if link[node] >= 0:
                children[link[node]].append(node)
            away = squares + squares[node] - 2 * (x @ x[node])
            closer = left & (away < near)
            near[closer], link[closer] = away[closer], node
            node = int(np.argmin(np.where(left, near, np.inf)))
        size = np.ones(n, dtype=np.int64)
        for v in reversed(joined[1:]):
            size[link[v]] += size[v]
        order, waiting = [], [(0, -1, False)]
        parent, last = [], []
        while waiting:
            v, above, is_last = waiting.pop()
            parent.append(above)
            last.append(is_last)
            own = sorted(children[v], key=lambda c: size[c])
            waiting += [(c, len(order), c == own[-1]) for c in reversed(own)]
            order.append(v)
        nodes, above = np.array(order, dtype=np.int64), np.array(parent, dtype=np.int64)
        edge = np.sqrt(((x[nodes] - x[nodes[np.maximum(above, 0)]]) ** 2).sum(axis=1)) if n else np.zeros(0)
        return cls(vectors[nodes], above, edge, np.array(last, dtype=bool)), nodes

    def walk(self, rows: np.ndarray, norms: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each node the rows that wanted(node, low, high) chooses by their bounds, and their exact scores."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        biggest = float(norms.max(initial=0)) * float(np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        slack = 1 + biggest * 1e-12  # more than doubles can be off by
        has_children = np.zeros(len(self.parent), dtype=bool)
        has_children[self.parent[self.parent >= 0]] = True
        for node in range(len(self.parent)):
            above = self.parent[node]
            if above < 0:
                low, high = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
            else:
                low, high = held.pop(above) if self.last[node] else held[above]
                reach = norms * self.edge[node] + slack
                low, high = low - reach, high + reach
            chosen = np.flatnonzero(wanted(node, low, high))
            if above < 0 or len(chosen) > RESCORE_ALL * len(rows):
                scores = rows @ self.vectors[node]
                low = high = scores.astype(np.float64)
                scores = scores[chosen]
            else:
                scores = rows[chosen] @ self.vectors[node]
                low[chosen] = high[chosen] = scores
            if has_children[node]:
                held[node] = low, high
            yield node, chosen, scores.astype(np.int64)


class _Best:
    """The k first rows of a list: higher scores, then smaller ids, then smaller row numbers."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores = self.ids = self.rows = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(self.scores) == self.k:
            near = scores >= self.scores[-1]
            scores, ids, rows = scores[near], ids[near], rows[near]
        if not len(scores):
            return
        scores, ids, rows = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -scores))[: self.k]
        self.scores, self.ids, self.rows = scores[order], ids[order], rows[order]

    def floor(self) -> float:
        """What a row's score must reach to be among them."""
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _matrix(column: pa.Array, dim: int, exact: bool) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), dtype=np.float64 if exact else np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


@dataclass
class _Block:
    """A block's anchors: rows, ids and labels, and trees of some of them with the places of their nodes in these."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    trees: list[tuple[int | None, Tree, np.ndarray]]  #: label of the rows that a tree is for, or None for all
    positives: list[_Best]


def _batches(batches: Iterator[pa.RecordBatch], dim: int, exact: bool) -> Iterator[tuple]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("q"), dim, exact)
            ids = batch.column("vec_id").fill_null(NO_ID).to_numpy()
            yield x, np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)), ids, batch.column("row").to_numpy(), batch.column("label").to_numpy()


def _sent(block: _Block, found: Iterator[tuple[int, int, _Best]]) -> pa.RecordBatch:
    """What a task has for each anchor and place of a positive."""
    out: dict[str, list] = {"anchor": [], "place": [], "anchor_id": [], "positive_id": [], "positive_score": [], "score": [], "id": [], "row": []}
    for a, place, best in found:
        n = len(best.scores)
        pair = (block.positives[a].ids[place], block.positives[a].scores[place]) if place >= 0 else (NO_ID, 0)
        for name, value in zip(out, (block.rows[a], place, block.ids[a], *pair), strict=False):
            out[name] += [int(value)] * n
        for name, values in (("score", best.scores), ("id", best.ids), ("row", best.rows)):
            out[name] += values.tolist()
    columns = {n: pa.array(v, pa.int32() if n == "place" else pa.int64()) for n, v in out.items()}
    return pa.RecordBatch.from_pydict(columns)


def _positives(shared, dim: int, exact: bool, k: int):
    """The k best rows of each anchor's label, among a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = [_Best(k) for _ in block.rows]
        for x, norms, ids, rows, labels in _batches(batches, dim, exact):
            for label, tree, places in block.trees:
                of_label = np.flatnonzero(labels == label)
                if not len(of_label):
                    continue
                own_rows, own_ids = rows[of_label], ids[of_label]
                order = np.argsort(own_rows)
                at = np.minimum(np.searchsorted(own_rows[order], block.rows[places]), len(order) - 1)
                itself = np.where(own_rows[order[at]] == block.rows[places], order[at], -1)

                def wanted(node: int, low: np.ndarray, high: np.ndarray, places=places, itself=itself) -> np.ndarray:
                    floor = best[places[node]].floor()
                    if itself[node] >= 0:
                        low, high = low.copy(), high.copy()
                        low[itself[node]] = high[itself[node]] = -np.inf
                    floor = max(floor, _kth(low, k))
                    return high >= floor if floor > -np.inf else high > -np.inf

                for node, chosen, scores in tree.walk(x[of_label], norms[of_label], wanted):
                    best[places[node]].add(scores, own_ids[chosen], own_rows[chosen])
        yield _sent(block, ((a, -1, b) for a, b in enumerate(best)))

    return run


def _negatives(shared, dim: int, exact: bool, k: int, low_share: int, high_share: int):
    """For each anchor and positive the k best rows of other labels inside the positive's window, among a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        windows = [[(-(-low_share * p // 100), high_share * p // 100) for p in b.scores.tolist()] for b in block.positives]
        best = [[_Best(k) for _ in w] for w in windows]
        for x, norms, ids, rows, labels in _batches(batches, dim, exact):
            ((_, tree, places),) = block.trees

            def wanted(node: int, low: np.ndarray, high: np.ndarray, places=places, labels=labels) -> np.ndarray:
                a = places[node]
                open_windows = [(lo, hi, b) for (lo, hi), b in zip(windows[a], best[a], strict=True) if lo <= hi]
                if not open_windows:
                    return np.zeros(len(low), dtype=bool)
                least = min(max(lo, b.floor()) for lo, _, b in open_windows)
                most = max(hi for _, hi, _ in open_windows)
                return (high >= least) & (low <= most) & (labels != block.labels[a])

            for node, chosen, scores in tree.walk(x, norms, wanted):
                a = places[node]
                for (lo, hi), b in zip(windows[a], best[a], strict=True):
                    inside = chosen[own := (scores >= lo) & (scores <= hi)]
                    b.add(scores[own], ids[inside], rows[inside])
        yield _sent(block, ((a, j, b) for a, of_anchor in enumerate(best) for j, b in enumerate(of_anchor)))

    return run


def hard_negatives(vectors: DataFrame, *, anchor: Column, positives: int = 5, negatives: int = 3, low_share: int = 50, high_share: int = 95, block_bytes: int = 4 << 20) -> DataFrame:
    """Per anchor and positive of (vec_id, embedding, label) the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components count as floor(256*x).  Rows with a null label, a null vector or null or non-finite components take no part,
    and neither do those whose scores could leave a long (norms of 2**31 and more after scaling).  A shorter vector counts
    as padded with zeros, an empty one is all zeros.  Rows that share a vec_id are rows of their own, which go by an
    internal number where all else is equal; a null vec_id comes after all others and is given as null.  anchor: which
    rows are anchors; null is no.  Other columns are ignored; an empty table gives none.

    block_bytes: what a block's vectors take; all rows are read twice for each block.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    rows = vectors.withColumn("_anchor", F.coalesce(anchor, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.col("label").cast("long").alias("label"), F.col("_anchor").alias("anchor"))
    rows = rows.where(F.col("x").isNotNull() & F.col("label").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e15)))
    rows = rows.withColumn("q", F.transform("x", lambda v: F.floor(v * 256)))
    rows = rows.where(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) < MOST_NORM)
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", "q"), "rows")
    about = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0)), F.coalesce(F.max(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))), F.lit(0.0)), F.count_if("anchor")).first()
    dim, exact, n = max(1, about[0]), about[1] < EXACT, about[2]
    n_blocks = -(-n // max(1, block_bytes // (8 * dim)))
    if not n:
        return spark.createDataFrame([], RESULT)
    anchors = stored(rows.where("anchor").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks))), "anchors")
    candidates = rows.select("row", "vec_id", "label", "q")
    order = [F.desc("score"), F.asc("id"), F.asc("row")]
    path = fresh_path(spark, "negatives")
    for b in range(n_blocks):
        own = anchors.where(F.col("block") == b).select("row", "vec_id", "label", "q").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        x = _matrix(own.column("q").chunk(0), dim, exact)
        anchor_rows, labels = own.column("row").to_numpy(), own.column("label").to_numpy()
        per_label = [(int(v), np.flatnonzero(labels == v)) for v in np.unique(labels)]
        trees = [(v, tree, at[nodes]) for v, at in per_label for tree, nodes in [Tree.of(x[at])]]
        block = _Block(anchor_rows, own.column("vec_id").fill_null(NO_ID).to_numpy(), labels, trees, [])
        shared = spark.sparkContext.broadcast(block)
        near = candidates.mapInArrow(_positives(shared, dim, exact, positives), FOUND)
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("n") <= positives)
        found = near.select("anchor", "score", "id", "row").toArrow()  # a few rows for each anchor of the block
        shared.unpersist()
        best = {r: _Best(positives) for r in anchor_rows.tolist()}
        for a, score, i, row in zip(*(c.to_pylist() for c in found.columns), strict=True):
            best[a].add(np.array([score]), np.array([i]), np.array([row]))
        tree, nodes = Tree.of(x)
        block = _Block(anchor_rows, block.ids, labels, [(None, tree, nodes)], [best[r] for r in anchor_rows.tolist()])
        shared = spark.sparkContext.broadcast(block)
        hard = candidates.mapInArrow(_negatives(shared, dim, exact, negatives, low_share, high_share), FOUND)
        hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= negatives)
        an_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(f"{c.removesuffix('_id')}_id" if c != "id" else "negative_id")
        hard.select(an_id("anchor_id"), an_id("positive_id"), "rank", an_id("id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(RESULT).parquet(path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, anchor=F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
