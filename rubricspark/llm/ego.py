"""Embedding near-dedup by an epsilon grid order join.

Unit vectors at cosine t or more lie within epsilon = sqrt(2 - 2t). Vectors are sorted by their grid cells (of side
epsilon) on the leading principal dimensions and cut into blocks, runs of that order. Boxes of ever longer intervals of
the sequence form a tree of tables. The join goes down that tree: pairs of intervals whose boxes lie farther apart than
epsilon are dropped with all they hold, the others are split. Surviving pairs of blocks meet in tiles of bounded size,
where numpy compares them block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

COSINE = 0.9
#: Leading principal dimensions: those of the grid order, and those of the boxes that prove distance.
GRID_DIMS, BOX_DIMS = 4, 12
#: Vectors in a block, and intervals that one of the next level holds.
BLOCK, FAN = 512, 8
#: Bytes of vectors along one side of a tile, and the most blocks there.
TILE_BYTES, MOST_TILE = 1 << 23, 64


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row for each distinct usable vector: rep (its smallest id), copies, v (array<double>, or float if they are)."""
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return usable.groupBy("v").agg(F.min("id").alias("rep"), F.count("id").alias("copies"))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _raw(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(_raw(column))


def _principal(classes: DataFrame, dim: int) -> np.ndarray:
    """Principal directions of all vectors; each partition sends one dim x dim matrix."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"))
                total, first, n = total + m.T @ m, first + m.sum(axis=0), n + len(m)
        if n:
            cells = np.concatenate([total.ravel(), first, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["k", "x"])

    cells = classes.select("v").mapInArrow(moments, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    x = cells.sort_values("k")["x"].to_numpy()
    n, mean = x[-1], x[dim * dim : -1] / x[-1]
    values, directions = np.linalg.eigh(x[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean))
    return directions[:, np.argsort(-values)]


def _compare(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of unit rows are at the cosine or above, in double precision; float products only rule out."""
    rough = a.astype(np.float32) @ b.astype(np.float32).T
    hit = rough >= cosine + 1e-4
    i, j = np.nonzero((rough >= cosine - 1e-4) & ~hit)
    for lo in range(0, len(i), 8192):
        x, y = i[lo : lo + 8192], j[lo : lo + 8192]
        hit[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
    return hit


class Forest:
    """Union of items 0..n-1; the root of a tree is its smallest item."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, items: np.ndarray) -> np.ndarray:
        at = self.up[items]
        while (up := self.up[at]).shape and (up != at).any():
            at = up
        self.up[items] = at
        return at

    def join(self, x: np.ndarray, y: np.ndarray, hit: np.ndarray) -> None:
        """Connects x[i] with y[j] wherever hit[i, j], without listing the pairs: least roots spread over rows and columns."""
        rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(rows):
            return
        hit, far = hit[np.ix_(rows, columns)], len(self.up)
        old = np.concatenate([self.roots(x[rows]), self.roots(y[columns])])
        a, b = old[: len(rows)].copy(), old[len(rows) :].copy()
        while True:
            less_a = np.minimum(a, np.where(hit, b, far).min(axis=1))
            less_b = np.minimum(b, np.where(hit, less_a[:, None], far).min(axis=0))
            if (less_a == a).all() and (less_b == b).all():
                break
            a, b = less_a, less_b
        new = np.concatenate([a, b])
        for u, v in np.unique(np.stack([old, new], axis=1)[old != new], axis=0):
            u, v = int(self.roots(np.array([u]))[0]), int(self.roots(np.array([v]))[0])
            self.up[max(u, v)] = min(u, v)


def _join_tile(rows: pd.DataFrame, pairs: list[tuple[int, int]], cosine: float) -> pd.DataFrame:
    """Links within one tile. a = b: the copies that a class links with (n); else two classes that links connect."""
    side = {r.block: (np.frombuffer(r.reps, "<i8"), np.frombuffer(r.copies, "<i8"), _unit(np.frombuffer(r.vectors, r.kind).reshape(len(r.reps) // 8, -1))) for r in rows.itertuples()}
    blocks, start, n = sorted(side), {}, 0
    for b in blocks:
        start[b], n = n, n + len(side[b][0])
    reps = np.concatenate([side[b][0] for b in blocks])
    linked, forest = np.zeros(n, np.int64), Forest(n)
    place = {b: start[b] + np.arange(len(side[b][0])) for b in blocks}
    for x, y in sorted(pairs):
        hit = _compare(side[x][2], side[y][2], cosine)
        if x == y:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        linked[place[x]] += hit @ side[y][1]
        if x != y:
            linked[place[y]] += hit.T @ side[x][1]
        forest.join(place[x], place[y], hit)
    root, keep = forest.roots(np.arange(n)), linked > 0
    hung = keep & (root != np.arange(n))
    out = pd.DataFrame({"a": np.concatenate([reps[keep], reps[hung]]), "b": np.concatenate([reps[keep], reps[root[hung]]]), "n": np.concatenate([linked[keep], np.zeros(int(hung.sum()), np.int64)])})
    return out.astype("int64")


def epsilon_join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept.

    n_links counts the other rows within the cosine, copies too; component_id is the smallest id reachable over
    links; kept marks that row. Vectors that are null, empty, zero, or hold a null or a non-finite component link with
    nothing. Lengths may differ: only vectors of one length are compared. Equal rows (one id twice) are copies of each
    other. Ids are whole numbers; a row with a null id links with nothing. A cosine of exactly the limit links. An empty
    table gives an empty one; only the two columns are looked at, so others may have any name.
    """
    usable = materialize(_classes(vectors.filter(F.col(id_col).isNotNull()), id_col, vector_col))
    dims = [r[0] for r in usable.select(F.size("v").alias("d")).distinct().limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("vectors of more than 1000 lengths")
    found = None
    for d in sorted(dims):
        part = _join_dimension(usable.filter(F.size("v") == d), d, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = usable.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("copies").alias("n"))
    found = materialize(found)
    counts = found.filter("a = b").groupBy("a").agg(F.sum("n").alias("linked"))
    roots = connected_components(found.filter("a <> b").select("a", "b"))
    classes = usable.join(counts, usable["rep"] == counts["a"], "left").join(roots, usable["rep"] == roots["node"], "left")
    classes = classes.select(F.col("v").alias("_v"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    kind = usable.schema["v"].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.col(id_col).isNotNull(), F.col(vector_col).cast(kind)).alias("_v"))
    # rows without a vector would all meet in one task of the join
    out = rows.filter("_v IS NOT NULL").join(classes, "_v", "left")
    alone = rows.filter("_v IS NULL").select(*[F.col(c) if c in rows.columns else F.lit(None).cast("long").alias(c) for c in out.columns])
    out = out.unionByName(alone)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


#: What epsilon_join gives for ``embeddings``, for DuckDB: all pairs, and what links reach.
OP10_SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(l.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""


def _near(a: str, b: str, eps: float, dims: int) -> Column:
    """Whether the boxes of rows a and b lie within eps of each other."""
    gap = [F.greatest(F.lit(0.0), F.col(f"{a}.low")[k] - F.col(f"{b}.high")[k], F.col(f"{b}.low")[k] - F.col(f"{a}.high")[k]) for k in range(dims)]
    return sum((g * g for g in gap), F.lit(0.0)) <= eps * eps


def block_pairs(boxes: DataFrame, blocks: int, dims: int, eps: float) -> DataFrame:
    """(x, y), x <= y: blocks whose boxes (block, low, high) lie within eps, from the longest intervals down."""
    levels = [boxes.select(F.col("block").alias("id"), "low", "high")]
    while blocks > FAN:
        up = levels[-1].groupBy(F.expr(f"id div {FAN}").alias("id"))
        least = [F.min(F.col("low")[k]) for k in range(dims)]
        most = [F.max(F.col("high")[k]) for k in range(dims)]
        levels.append(materialize(up.agg(F.array(*least).alias("low"), F.array(*most).alias("high"))))
        blocks = -(-blocks // FAN)
    pairs = None
    for level in reversed(levels):
        if pairs is None:  # FAN intervals at most
            pairs = level.select(F.col("id").alias("x"), F.explode(F.sequence(F.col("id"), F.lit(blocks - 1))).alias("y"))
        else:
            child = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)).alias(c)
            pairs = pairs.select(child("x"), "y").select("x", child("y")).filter("x <= y")
        both = pairs.join(level.alias("p"), F.col("x") == F.col("p.id")).join(level.alias("q"), F.col("y") == F.col("q.id"))
        pairs = materialize(both.filter(_near("p", "q", eps, dims)).select("x", "y"))
    return pairs


def _join_dimension(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    directions = _principal(classes, dim)
    eps = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    grid, boxed = min(GRID_DIMS, dim), min(BOX_DIMS, dim)
    kind = classes.schema["v"].dataType.simpleString()
    number = "<f4" if kind == "array<float>" else "<f8"

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.floor((_matrix(batch.column("v")) @ directions[:, :grid] + 1) / eps).astype(np.int64)
                key = np.zeros(len(cell), np.int64)
                for k in range(grid):
                    key = key * 4096 + np.clip(cell[:, k], 0, 4095)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("v"), pa.array(key)], names=["rep", "copies", "v", "cell"])

    parts = max(1, -(-classes.count() // (4 * BLOCK)))
    keyed = classes.select("rep", "copies", "v").mapInArrow(order, f"rep long, copies long, v {kind}, cell long")
    ordered = keyed.repartitionByRange(parts, "cell", "rep").sortWithinPartitions("cell", "rep").withColumn("part", F.spark_partition_id())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seq = [], 0

        def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            raw = _raw(t.column("v").combine_chunks() if isinstance(t.column("v"), pa.ChunkedArray) else t.column("v"))
            p = _unit(raw) @ directions[:, :boxed]
            values = [t.column("part")[0].as_py(), seq, 1, t.column("rep").to_numpy().astype("<i8").tobytes(), t.column("copies").to_numpy().astype("<i8").tobytes(), raw.astype(number).tobytes(), number, p.min(axis=0).tolist(), p.max(axis=0).tolist()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "seq", "one", "reps", "copies", "vectors", "kind", "low", "high"])

        size = 0
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                take = min(BLOCK - size, batch.num_rows - lo)
                held.append(batch.slice(lo, take))
                size, lo = size + take, lo + take
                if size == BLOCK:
                    yield out(held)
                    held, size, seq = [], 0, seq + 1
        if size:
            yield out(held)

    kinds = "part int, seq long, one long, reps binary, copies binary, vectors binary, kind string, low array<double>, high array<double>"
    packed = materialize(ordered.mapInArrow(blocks, kinds))
    # the number of a block is its place in the sequence: blocks of earlier parts, then its own number
    ahead = packed.groupBy("part").agg(F.sum("one").alias("blocks"))
    total = packed.count()
    ahead = materialize(_in_order(ahead, "part", "blocks", "before"))
    numbered = packed.join(ahead.select("part", "before"), "part").withColumn("block", F.col("before") + F.col("seq"))
    numbered = materialize(numbered.select("block", "reps", "copies", "vectors", "kind", "low", "high"))
    pairs = block_pairs(numbered.select("block", "low", "high"), total, boxed, eps)

    # a tile holds the blocks of two groups that a pair brings together, each once
    side = max(1, min(MOST_TILE, TILE_BYTES // (BLOCK * dim * int(number[2]))))
    tiles = pairs.select(F.expr(f"x div {side}").alias("tx"), F.expr(f"y div {side}").alias("ty"), "x", "y")
    wanted = tiles.select("tx", "ty", F.col("x").alias("block")).unionByName(tiles.select("tx", "ty", F.col("y").alias("block"))).distinct()
    placed = wanted.join(numbered.select("block", "reps", "copies", "vectors", "kind"), "block")
    listed = materialize(tiles.groupBy("tx", "ty", "x").agg(F.collect_list("y").alias("ys")))  # at most a side's blocks

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _join_tile(left, [(int(r.x), int(y)) for r in right.itertuples() for y in r.ys], cosine)

    return placed.groupBy("tx", "ty").cogroup(listed.groupBy("tx", "ty")).applyInPandas(compare, "a long, b long, n long")


def _in_order(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows with a smaller ``key`` (a number without gaps but for empty parts)."""
    fan = 4096
    up = df.groupBy(F.expr(f"{key} div {fan}").alias("up")).agg(F.sum(value).alias("own"))
    above = up.alias("u").withColumn("base", F.coalesce(F.sum("own").over(Window.orderBy("up").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("up").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("up", F.expr(f"{key} div {fan}")).withColumn("within", within).join(above.select("up", "base"), "up").withColumn(out, F.col("base") + F.col("within")).drop("up", "within", "base")
