"""Nearest neighbours for a whole table of queries.

Exact search is a block product: vectors are cut into slices of bounded size, queries into
blocks of bounded size, and every (slice, block) pair is one cogroup whose distances come from
one matrix product. A cogroup returns only the best rows per query (and per cell), never the
pairs, and a window merges the slices. Nothing is broadcast and no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Distances are compared after rounding, so that equal vectors tie exactly on every engine.
DISTANCE_DIGITS = 9
# Vectors of a slice and queries of a block; with cells a group returns rows per cell, so it is smaller.
SLICE_ROWS, CELL_SLICE_ROWS = 60_000, 20_000
BLOCK_QUERIES, CELL_BLOCK_QUERIES = 8_192, 2_048
_PRODUCT_QUERIES = 32


@dataclass(frozen=True)
class Refinement:
    """What is made of the best rows where they are found, so that only its rows leave the task.

    ``make`` gets the queries and rows of a group, sorted by cell and row id, and gives a function that turns best rows, told as the
    places of query and row, distances and ranks, into a table of ``schema``; the cells of a query are whole. ``beside`` (query id, cell and further columns) is told to the
    kernel as ``_beside``, an array of structs of the cell and the further columns for each query and slice.
    """

    make: Callable[[pa.Table, pa.Table], Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table]]
    schema: T.StructType
    beside: DataFrame | None = None


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = values.chunk(0)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, m / norms, np.nan)


def _best(distances: np.ndarray, limit: int) -> np.ndarray:
    """Positions of the smallest values; equal values keep their order."""
    usable = np.flatnonzero(~np.isnan(distances))
    if len(usable) > limit:
        part = distances[usable]
        bound = np.partition(part, limit - 1)[limit - 1]
        usable = usable[part <= bound]
    order = np.argsort(distances[usable], kind="stable")
    return usable[order][:limit]


def _block_kernel(query_cols: Sequence[str], row_cols: Sequence[str], sort_cols: Sequence[str], cell: str | None, make: Callable | None = None):
    def kernel(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ([cell] if cell else []) + list(sort_cols)])
        picked_q: list[np.ndarray] = []
        picked_r: list[np.ndarray] = []
        picked_d: list[np.ndarray] = []
        places: list[np.ndarray] = []
        made: list[pa.Table] = []
        refined = make and make(queries, rows)
        if len(queries) and len(rows):
            if cell:
                cells = rows.column(cell).to_numpy()
                starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            else:
                starts = np.array([0])
            ends = np.r_[starts[1:], len(rows)]
            q = _unit_rows(_matrix(queries.column("_qvec")))
            v = _unit_rows(_matrix(rows.column("_vec")))
            limits = queries.column("_limit").to_numpy()
            for first in range(0, len(q), _PRODUCT_QUERIES):
                block = np.round(1.0 - q[first : first + _PRODUCT_QUERIES] @ v.T, DISTANCE_DIGITS)
                for i, line in enumerate(block):
                    for start, end in zip(starts, ends):
                        best = _best(line[start:end], int(limits[first + i])) + start
                        picked_q.append(np.full(len(best), first + i))
                        picked_r.append(best)
                        picked_d.append(line[best])
                        places.append(np.arange(1, len(best) + 1, dtype=np.int32))
                if refined:
                    made.append(refined(*(np.concatenate(x) for x in (picked_q, picked_r, picked_d, places))))
                    for x in (picked_q, picked_r, picked_d, places):
                        x.clear()
        if made:
            return pa.concat_tables(made)
        if not picked_q:
            picked_q, picked_r, picked_d, places = ([np.array([], t)] for t in (int, int, float, np.int32))
        if refined:
            return refined(*(np.concatenate(x) for x in (picked_q, picked_r, picked_d, places)))
        qi, ri = np.concatenate(picked_q).astype(int), np.concatenate(picked_r).astype(int)
        out = {c: queries.column(c).take(pa.array(qi)) for c in query_cols}
        out |= {c: rows.column(c).take(pa.array(ri)) for c in row_cols}
        out["distance"] = pa.array(np.concatenate(picked_d))
        out["rank"] = pa.array(np.concatenate(places))
        return pa.table(out)

    return kernel


def knn_join(
    queries: DataFrame,
    vectors: DataFrame,
    query_id: str,
    row_id: Sequence[str],
    limit: str | int,
    query_vector: str = "embedding",
    vector: str = "embedding",
    match: Sequence[str] = (),
    cell: str | None = None,
    slice_rows: int | None = None,
    block_queries: int | None = None,
    refine: Refinement | None = None,
) -> DataFrame:
    """Nearest rows per query (and per ``cell``): all columns of both sides but the vectors,
    with ``distance`` and ``rank``. With ``cell`` a cell is never cut, so cells have to be bounded
    (shards are); without it rows are cut freely and a window merges the slices.

    ``match`` names columns both sides must share (a vector column kind, an inverted list);
    ``limit`` is a number or a query column; ties are cut by ``row_id``. Counting both
    inputs once sizes the slices and blocks. With ``refine``, which needs a ``cell``, its rows are given instead.
    """
    if refine and not cell:
        raise ValueError("rows are refined within cells")
    limit_col = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    slice_rows = slice_rows or (CELL_SLICE_ROWS if cell else SLICE_ROWS)
    block_queries = block_queries or (CELL_BLOCK_QUERIES if cell else BLOCK_QUERIES)
    # Sizing: the largest matching part decides how many slices every part is cut into, the one asked most how many blocks.
    if match:
        largest = vectors.groupBy(*match).count().agg(F.max("count")).first()[0] or 0
    else:
        largest = vectors.count()
    slices = max(1, -(-largest // slice_rows))
    per_part = queries.groupBy(*match).agg(F.count(F.lit(1)).alias("n"), F.max(limit_col).alias("deepest"))
    asked = per_part.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("deepest"), F.lit(0)).alias("deepest")).first()
    blocks = max(1, -(-asked["n"] // block_queries))

    q_cols = [c for c in queries.columns if c != query_vector]
    r_cols = [c for c in vectors.columns if c != vector and c not in match]
    q_side = (
        queries.where(F.col(query_vector).isNotNull())
        .withColumnRenamed(query_vector, "_qvec")
        .withColumn("_limit", limit_col.cast("long"))
        .withColumn("_block", F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int"))
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    )
    spread = [cell] if cell else list(row_id)
    if refine and refine.beside is not None:
        more = [c for c in refine.beside.columns if c != query_id]
        told = refine.beside.withColumn("_slice", F.pmod(F.xxhash64(cell), F.lit(slices)).cast("int"))
        q_side = q_side.join(told.groupBy(query_id, "_slice").agg(F.collect_list(F.struct(*more)).alias("_beside")), [query_id, "_slice"], "left")
    v_side = (
        vectors.where(F.col(vector).isNotNull())
        .withColumnRenamed(vector, "_vec")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(slices)).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    keys = [*match, "_slice", "_block"]
    schema = T.StructType(
        [queries.schema[c] for c in q_cols]
        + [vectors.schema[c] for c in r_cols]
        + [T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    )
    near = (
        q_side.groupBy(*keys)
        .cogroup(v_side.groupBy(*keys))
        .applyInArrow(_block_kernel(q_cols, r_cols, row_id, cell, refine and refine.make), refine.schema if refine else schema)
    )
    if cell or slices == 1:
        # A cell lies in one slice, so the order inside the cogroup is the final one.
        return near
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy("distance", *row_id)))
    # The literal bound lets Spark cut every partition before the shuffle.
    return ranked.where((F.col("rank") <= asked["deepest"]) & (F.col("rank") <= limit_col))


def ivf_fit(vectors: DataFrame, lists: int, seed: int = 7, vector: str = "embedding") -> DataFrame:
    """Centroids (list_id, centroid) of a coarse k-means; at most ``lists`` rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.where(F.col(vector).isNotNull()).select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features")
    )
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=10).fit(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "list_id int, embedding array<double>")


def ivf_assign(vectors: DataFrame, centroids: DataFrame, row_id: str, probes: int = 1, vector: str = "embedding") -> DataFrame:
    """Each vector with its ``probes`` nearest lists (list_id, distance, rank dropped)."""
    centres = centroids.collect()  # at most ``lists`` rows
    ids = np.array([r["list_id"] for r in centres])
    points = _unit_rows(np.array([r["embedding"] for r in centres], dtype=float))
    names = vectors.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            near = np.round(1.0 - _unit_rows(_matrix(table.column(vector))) @ points.T, DISTANCE_DIGITS)
            order = np.argsort(near, axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(batch.num_rows), order.shape[1])
            taken = table.take(pa.array(at))
            taken = taken.append_column("list_id", pa.array(ids[order.ravel()], pa.int32()))
            yield from taken.to_batches()

    schema = T.StructType([*[vectors.schema[c] for c in names], T.StructField("list_id", T.IntegerType())])
    return vectors.where(F.col(vector).isNotNull()).mapInArrow(assign, schema)


def ivf_knn(
    queries: DataFrame,
    vectors: DataFrame,
    query_id: str,
    row_id: Sequence[str],
    limit: str | int,
    lists: int,
    probes: int,
) -> DataFrame:
    """Approximate neighbours: only the ``probes`` nearest lists of each query are searched.

    A list holding much of the table is cut into slices by ``knn_join`` like any other part.
    """
    centroids = ivf_fit(vectors, lists)
    listed = ivf_assign(vectors, centroids, row_id[0], 1)
    probed = ivf_assign(queries, centroids, query_id, probes)
    return knn_join(probed, listed, query_id, row_id, limit, match=["list_id"]).drop("list_id")
