"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are rotated onto the principal axes of a sample, so that leading
dimensions carry most of a product, and dealt by a small tree of cuts along
leading axes into cells and these into tiles of bounded size.  Two cells whose
boxes are further apart than the threshold allows are not compared.  A pair of
tiles accumulates products over the leading dimensions first; the norms of what
is left bound the rest, and a tile, or the pairs left in it, is given up as soon as
the cosine can't reach the threshold.  What comes near it is decided in double
precision on the original components.

Equal vectors are one node with a multiplicity.  A pair of tiles returns for each
vector the number of links and the smallest member of its connected part, never
the links themselves, so that a large group of near copies costs comparisons but
no output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.components import components
from dossier.llm.scratch import dropped, stored

SLACK = 1e-4  #: more than float32 sums can be off by


class _Cells:
    """A tree of cuts at medians of a sample, along the leading axis with the largest spread."""

    def __init__(self, sample: np.ndarray, rotation: np.ndarray, most_cells: int, axes: int = 16) -> None:
        self.rotation, self.cuts = rotation, []
        level = [(sample @ rotation)[:, :axes]]
        while len(level) < most_cells and max(len(x) for x in level) >= 2:
            cut, below = [], []
            for x in level:
                axis = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
                value = float(np.median(x[:, axis])) if len(x) else 0.0
                cut.append((axis, value))
                below += [x[x[:, axis] < value], x[x[:, axis] >= value]] if len(x) else [x, x]
            self.cuts.append((np.array([a for a, _ in cut]), np.array([v for _, v in cut])))
            level = below
        self.n = len(level)

    def cell(self, unit: np.ndarray) -> np.ndarray:
        rotated = unit @ self.rotation
        at = np.zeros(len(unit), dtype=np.int64)
        for axis, value in self.cuts:
            at = 2 * at + (rotated[np.arange(len(unit)), axis[at]] >= value[at])
        return at


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of up to dim numbers as rows, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; by the largest component first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _tile_links(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float, step: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the pairs with a cosine of threshold or more; without those of a row with itself if a and b are one."""
    ra, rb = (a @ rotation).astype(np.float32), (b @ rotation).astype(np.float32)
    dim = ra.shape[1]
    edges = [*range(step, dim, step), dim]
    tail = [[np.sqrt((r[:, e:].astype(np.float64) ** 2).sum(axis=1)).astype(np.float32) for e in edges] for r in (ra, rb)]
    rows, columns = [], []
    for top in range(0, len(ra), 512):
        part = slice(top, top + 512)
        products = ra[part, : edges[0]] @ rb[:, : edges[0]].T
        pairs = None
        for k, edge in enumerate(edges):
            if k:
                piece = slice(edges[k - 1], edge)
                if pairs is None:
                    products += ra[part, piece] @ rb[:, piece].T
                else:
                    i, j, s = pairs
                    pairs = i, j, s + np.einsum("ij,ij->i", ra[part][i][:, piece], rb[j][:, piece])
            if pairs is None:
                left = products + tail[0][k][part][:, None] * tail[1][k] >= threshold - SLACK
                n = np.count_nonzero(left)
                if n * 8 < left.size or edge == dim:
                    i, j = np.nonzero(left)
                    pairs = i, j, products[i, j]
            else:
                i, j, s = pairs
                left = s + tail[0][k][part][i] * tail[1][k][j] >= threshold - SLACK
                pairs = i[left], j[left], s[left]
            if pairs is not None and not len(pairs[0]):
                break
        i, j, s = pairs
        i = i + top
        if same:
            i, j, s = i[i != j], j[i != j], s[i != j]
        sure = s >= threshold + SLACK
        for at in range(0, len(i), 1 << 15):
            piece = slice(at, at + (1 << 15))
            close = np.flatnonzero(~sure[piece]) + at
            sure[close] = np.einsum("ij,ij->i", a[i[close]], b[j[close]]) >= threshold
        rows.append(i[sure])
        columns.append(j[sure])
    return np.concatenate(rows), np.concatenate(columns)


def _parts(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For links between numbered rows the smallest id that each row reaches."""
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, root[i])
        if (root == before).all():
            return root


def _read(blob: bytes, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(-1, dim).astype(np.float64)


def _compare(rotation, kind: str, dim: int, threshold: float, step: int):
    """The one or two tiles of a pair -> for each vector with links their number and the smallest node that it reaches."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("tile").to_pylist()
        ids, many = ([np.frombuffer(r[c], np.int64) for r in rows] for c in ("ids", "many"))
        unit = [_unit(_read(r["vectors"], kind, dim)) for r in rows]
        same = len(rows) == 1
        i, j = _tile_links(unit[0], unit[-1], rotation.value, threshold, step, same)
        if not same:
            j = j + len(ids[0])
        all_ids, all_many = np.concatenate(ids), np.concatenate(many)
        root = _parts(i, j, all_ids)
        links = np.bincount(i, weights=all_many[j], minlength=len(all_ids)).astype(np.int64)
        if not same:
            links += np.bincount(j, weights=all_many[i], minlength=len(all_ids)).astype(np.int64)
        hit = np.flatnonzero(links)
        return pa.table({"node": pa.array(all_ids[hit]), "links": pa.array(links[hit]), "root": pa.array(root[hit])})

    return run


def embedding_links(vectors: DataFrame, *, threshold: float = 0.9, tile_bytes: int = 8 << 20, least_tiles: int = 6, most_cells: int = 4096, sample_rows: int = 20_000, step: int = 16) -> DataFrame:
    """One row a vector of (vec_id, embedding array): vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and those with null or non-finite components link with nothing.  A shorter vector counts
    as padded with zeros.  Rows that share a vec_id are vectors of their own.  A vector without vec_id counts as a link of
    others and joins them, but never names a component; its own component_id is null and it is kept.  The axes come from
    about sample_rows vectors, and any axes give the same result.  Tiles are of about tile_bytes, or smaller where that
    makes fewer than least_tiles.  Each tile is sent to a task for each tile that it is compared with.
    """
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"  # what holds the given components as they are
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(usable, F.transform("embedding", lambda x: x + F.lit(0.0))))
    # two independent hashes of 64 bits stand for the vector
    rows = rows.withColumns({"k1": F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding", F.lit(1))), "k2": F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(2), "embedding"))})
    size = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)), F.count("embedding")).first()
    dim, n = max(1, size[0]), size[1]
    equal = rows.where("embedding IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("many"), F.first("embedding").alias("embedding"))
    distinct = stored(equal.withColumn("node", F.monotonically_increasing_id()), "vectors")

    chance = int(min(1.0, sample_rows / max(1, n)) * (1 << 20)) + 1
    sample = [r[0] for r in distinct.where(F.pmod(F.xxhash64("k1"), F.lit(1 << 20)) < chance).select("embedding").limit(2 * sample_rows).collect()]
    known = _unit(_matrix(pa.array(sample, pa.list_(pa.float64())), dim)) if sample else np.zeros((0, dim))
    rotation = np.linalg.eigh(known.T @ known)[1][:, ::-1].copy() if sample else np.eye(dim)
    tile_rows = max(1, min(tile_bytes // (dim * int(kind[2])), max(1024, n // least_tiles)))
    wanted = 1 << max(0, int(np.ceil(np.log2(max(1, n / tile_rows)))))
    cells = spark.sparkContext.broadcast(_Cells(known, rotation, min(most_cells, wanted)))
    shared = spark.sparkContext.broadcast(rotation)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim)
            cell = cells.value.cell(_unit(x)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("many"), pa.array(cell), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], names=["node", "many", "cell", "vector"])

    placed = stored(distinct.select("node", "many", "embedding").mapInArrow(dealt, "node long, many long, cell long, vector binary"), "placed")
    counts = {r["cell"]: max(1, round(r["n"] / tile_rows)) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # most_cells rows at most
    if not counts:
        counts = {0: 1}
    per_cell = spark.createDataFrame(sorted(counts.items()), "cell long, tiles long")
    tiled = placed.join(F.broadcast(per_cell), "cell").withColumn("tile", F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("node"), F.col("tiles")))
    tiles = stored(tiled.select("cell", "tile", "node", "many", "vector").groupBy("tile").applyInArrow(_tile(kind, dim, shared), "cell long, tile long, ids binary, many binary, vectors binary, low binary, high binary"), "tiles")
    dropped(placed)
    boxes = tiles.select("cell", "low", "high").groupBy("cell").applyInArrow(_boxes(dim), "cell long, low binary, high binary").collect()
    rotated = {r["cell"]: (np.frombuffer(r["low"]), np.frombuffer(r["high"])) for r in boxes}
    near = _near_cells(rotated, threshold)
    cell_pairs = F.broadcast(spark.createDataFrame(near, "cell_a long, cell_b long"))  # most_cells squared rows at most
    names = tiles.select("cell", "tile")
    pairs = cell_pairs.join(names.toDF("cell_a", "tile_a"), "cell_a").join(names.toDF("cell_b", "tile_b"), "cell_b").where("tile_a <= tile_b").select("tile_a", "tile_b")
    sent = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("tile_a", "tile_b")))).join(tiles.select("tile", "ids", "many", "vectors"), "tile")
    compare = _compare(shared, kind, dim, threshold, step)
    found = stored(sent.groupBy("tile_a", "tile_b").applyInArrow(compare, "node long, links long, root long"), "found")
    dropped(tiles)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = distinct.select("k1", "k2", "node", "many", "first_id").join(links, "node", "left").join(classes, "node", "left")
    per_node = per_node.select("k1", "k2", "first_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = per_node.groupBy("component").agg(F.min("first_id").alias("component_id"))  # the smallest id that is one
    out = rows.select("vec_id", "k1", "k2").join(per_node.join(least, "component").select("k1", "k2", "n_links", "component_id"), ["k1", "k2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _tile(kind: str, dim: int, rotation):
    def run(table: pa.Table) -> pa.Table:
        vectors = b"".join(table.column("vector").to_pylist())
        x = _unit(_read(vectors, kind, dim)) @ rotation.value
        blob = lambda v: pa.array([v], pa.binary())
        return pa.table({"cell": table.column("cell")[:1], "tile": table.column("tile")[:1], "ids": blob(table.column("node").to_numpy().tobytes()), "many": blob(table.column("many").to_numpy().tobytes()), "vectors": blob(vectors), "low": blob(x.min(axis=0).tobytes()), "high": blob(x.max(axis=0).tobytes())})

    return run


def _boxes(dim: int):
    def run(table: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(table.column("low").to_pylist())).reshape(-1, dim).min(axis=0)
        high = np.frombuffer(b"".join(table.column("high").to_pylist())).reshape(-1, dim).max(axis=0)
        return pa.table({"cell": table.column("cell")[:1], "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary())})

    return run


def _near_cells(boxes: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """The pairs of cells that can hold unit vectors with such a cosine: their boxes are within the chord."""
    names = sorted(boxes)
    low, high = np.array([boxes[c][0] for c in names]), np.array([boxes[c][1] for c in names])
    out = []
    for k, c in enumerate(names):
        gap = np.maximum(0, np.maximum(low[k] - high, low - high[k]))
        out += [(c, names[m]) for m in np.flatnonzero((gap * gap).sum(axis=1) <= 2 - 2 * threshold + SLACK) if m >= k]
    return out


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings),
u AS (SELECT vec_id, e, norm FROM v WHERE norm > 0 AND isfinite(norm)),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9 * a.norm * b.norm),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
