"""Stored inverted lists of vectors, searched with a bound per list.

Vectors are dealt to the nearest of about as many centroids as the square root of their number; lists that come out much larger than
the average are split by a second clustering of their own. The table is laid out by list, and each list keeps its radius, the largest
angle between its centroid and a member. By the triangle inequality no member is nearer to a query than the angle to the centroid less
the radius. A search looks into the nearest list first and then only into lists whose bound does not exceed the distance of the
last wanted neighbour: with all lists allowed the result is exact, with a number of probes it is approximate.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.operators.knn import _matrix, _unit_rows, ivf_fit, knn_join
from tarnwell.session import materialise
from tarnwell.sources.manifest import read_manifest, switch_manifest

#: Lists at most; their centroids are kept by every task. More vectors make longer lists, which a search cuts into slices.
MOST_LISTS = 16_384
#: Folders of the table at most.
MOST_PARTS = 1_024
#: Vectors the centroids are fitted to, for each list; vectors a split is fitted to.
FIT_SHARE, SPLIT_ROWS = 64, 4_096
#: A list with so many times the average is split.
OVERSIZE = 4
#: Pairs of a query and a list that a task holds at once; each open one is a row with the vector of its query.
PROBE_PAIRS = 32_768
#: Rounding of distances must not lower a bound below them.
MARGIN = 1e-7


@dataclass(frozen=True)
class VectorLists:
    """Opened lists: centroids and radii in memory, vectors on disk."""

    spark: SparkSession
    root: str
    manifest: dict
    centroids: np.ndarray
    radii: np.ndarray

    def rows(self, lists: DataFrame | None = None) -> DataFrame:
        """The vectors, or those in the folders of the wanted lists (list_id)."""
        table = self.spark.read.schema(self.manifest["schema"]).parquet(f"{self.root}/{self.manifest['vectors']}")
        if lists is None:
            return table
        parts = [r["part"] for r in lists.select(F.pmod("list_id", F.lit(self.manifest["parts"])).alias("part")).distinct().collect()]
        return table.where(F.col("part").isin(parts))


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid with the smallest angle to each point, and that angle."""
    cosine = points @ centres.T
    best = np.argmax(cosine, axis=1)
    return best, np.arccos(np.clip(cosine[np.arange(len(points)), best], -1, 1))


def _clusters(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a small clustering by angle, begun with points far from each other."""
    centres = points[:1]
    near = points @ points[0]
    for _ in range(k - 1):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-12:
            break  # all points are copies of centroids
        centres = np.vstack([centres, points[far]])
        near = np.maximum(near, points @ points[far])
    for _ in range(rounds):
        which, _ = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, which, points)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.maximum(lengths, 1e-300), centres)
    return centres


def _assign(vectors: DataFrame, vector: str, centres: np.ndarray, keep: list[str]) -> DataFrame:
    """The rows with their list and the angle to its centroid; vectors of no direction are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            points = _unit_rows(_matrix(table.column(vector)))
            fine = ~np.isnan(points).any(axis=1)
            which, angle = _nearest(points[fine], centres)
            taken = table.filter(pa.array(fine)).append_column("list_id", pa.array(which.astype(np.int32))).append_column("angle", pa.array(angle))
            yield from taken.to_batches()

    schema = T.StructType([*[vectors.schema[c] for c in keep], T.StructField("list_id", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return vectors.select(*keep).where(F.col(vector).isNotNull()).mapInArrow(run, schema)


def build_lists(vectors: DataFrame, root: str, lists: int | None = None, vector: str = "embedding", seed: int = 7) -> VectorLists:
    """Write the lists of a table of vectors; all its columns are kept. Rows whose vector is null or zero are left out."""
    spark, keep = vectors.sparkSession, vectors.columns
    n = vectors.where(F.col(vector).isNotNull()).count()
    wanted = max(1, min(MOST_LISTS, lists or math.isqrt(max(n, 1))))
    share = min(1.0, wanted * FIT_SHARE / max(n, 1))
    some = vectors.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
    sample = materialise((some.sample(share, seed) if share < 1 else some).select(vector), "list-sample")
    found = [] if sample.isEmpty() else [r["embedding"] for r in ivf_fit(sample.withColumnRenamed(vector, "embedding"), wanted, seed).collect()]
    centres = _unit_rows(np.array(found, float)) if found else np.zeros((0, 1))
    centres = centres[~np.isnan(centres).any(axis=1)]
    if len(centres):
        centres = _split_large(_assign(sample, vector, centres, [vector]), vector, centres)
    listed = materialise(_assign(vectors, vector, centres, keep), "listed") if len(centres) else None
    parts = max(1, min(MOST_PARTS, len(centres)))
    name = f"vectors-{uuid.uuid4().hex}"
    shape = T.StructType([*[vectors.schema[c] for c in keep], T.StructField("list_id", T.IntegerType()), T.StructField("part", T.IntegerType())])
    if listed is None:
        spark.createDataFrame([], shape).drop("part").write.parquet(f"{root}/{name}")
        radii = np.zeros(0)
    else:
        wide = {r["list_id"]: r["r"] for r in listed.groupBy("list_id").agg(F.max("angle").alias("r")).collect()}
        radii = np.array([wide.get(i, 0.0) for i in range(len(centres))])
        laid = listed.drop("angle").withColumn("part", F.pmod("list_id", F.lit(parts)).cast("int"))
        laid.repartition("part", F.pmod(F.xxhash64(vector), F.lit(max(1, n // (parts * 1_000_000))))).sortWithinPartitions("part", "list_id").write.partitionBy("part").parquet(f"{root}/{name}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    manifest = {"vectors": name, "schema": schema, "parts": parts, "vector": vector, "centroids": centres.tolist(), "radii": radii.tolist()}
    switch_manifest(spark, root, manifest)
    return VectorLists(spark, root, manifest, centres, radii)


def _split_large(listed: DataFrame, vector: str, centres: np.ndarray) -> np.ndarray:
    """The centroids, with those of lists that hold many times the average replaced by the centroids of a clustering of the list."""
    counts = {r["list_id"]: r["count"] for r in listed.groupBy("list_id").count().collect()}
    average = sum(counts.values()) / max(1, len(centres))
    large = {i: min(64, math.ceil(c / average)) for i, c in counts.items() if c > OVERSIZE * average}
    if not large:
        return centres
    few = listed.where(F.col("list_id").isin(list(large))).select("list_id", vector)
    picked = few.withColumn("_turn", F.row_number().over(W.partitionBy("list_id").orderBy(F.xxhash64(vector)))).where(F.col("_turn") <= SPLIT_ROWS).drop("_turn")

    def cluster(key, table):
        got = _clusters(_unit_rows(_matrix(table.column(vector))), large[key[0].as_py()])
        return pa.table({"list_id": pa.array([key[0].as_py()] * len(got), pa.int32()), "centre": pa.array(got.tolist(), pa.list_(pa.float64()))})

    parts = picked.groupBy("list_id").applyInArrow(cluster, "list_id int, centre array<double>").collect()
    kept = [c for i, c in enumerate(centres) if i not in large]
    return np.array([*kept, *[r["centre"] for r in sorted(parts, key=lambda r: (r["list_id"], r["centre"]))]])


def open_lists(spark: SparkSession, root: str) -> VectorLists:
    manifest = read_manifest(spark, root)
    if manifest is None:
        raise ValueError(f"there are no lists in {root}")
    return VectorLists(spark, root, manifest, np.array(manifest["centroids"], float), np.array(manifest["radii"], float))


def search_lists(
    index: VectorLists, queries: DataFrame, query_id: str, row_id: Sequence[str], limit: str | int, probes: int | None = None,
    match: Sequence[str] = (), query_vector: str = "embedding",
) -> DataFrame:
    """Nearest rows per query, as ``knn_join`` gives them without cells.

    ``probes``: lists looked into at most, the nearest first; None allows all, and the result is exact. A list that cannot
    hold a nearer row than the last wanted one found so far is not looked into. ``query_id`` is unique.
    """
    limit_col = (F.col(limit) if isinstance(limit, str) else F.lit(limit)).cast("long")
    asked = materialise(queries.where(F.col(query_vector).isNotNull()).withColumn("_wanted", limit_col), "list-queries")
    centres, radii, vector = index.centroids, index.radii, index.manifest["vector"]
    names = asked.columns
    out_schema = T.StructType([*asked.schema.fields, T.StructField("list_id", T.IntegerType())])
    step = max(1, PROBE_PAIRS // max(1, len(centres)))

    def probed(frame: DataFrame, later: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(first, step) for b in batches for first in range(0, b.num_rows, step)):
                if not len(centres):
                    continue
                table = pa.Table.from_batches([batch])
                points = _unit_rows(_matrix(table.column(query_vector)))
                fine = np.flatnonzero(~np.isnan(points).any(axis=1))
                angles = np.arccos(np.clip(points[fine] @ centres.T, -1, 1))
                order = np.argsort(angles, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
                if later:
                    kth = np.array([np.inf if x is None else x for x in table.column("_kth").to_pylist()])[fine]
                    nearest = 1 - np.cos(np.maximum(angles - radii[None, :], 0)) - MARGIN
                    open_ = (place > 0) & (nearest <= kth[:, None])
                    if probes is not None:
                        open_ &= place < probes
                else:
                    open_ = place == 0
                at, which = np.nonzero(open_)
                taken = table.select(names).take(pa.array(fine[at]))
                yield from taken.append_column("list_id", pa.array(which.astype(np.int32))).to_batches()

        return materialise(frame.mapInArrow(run, out_schema), "list-probes")

    def look(rows: DataFrame) -> DataFrame:
        vectors = index.rows(rows).drop("part").withColumnRenamed(vector, "_row_vector")
        return knn_join(rows, vectors, query_id, row_id, "_wanted", query_vector, "_row_vector", match=["list_id", *match]).drop("list_id", "rank")

    if not len(centres):
        return look(materialise(asked.withColumn("list_id", F.lit(0)), "list-probes")).withColumn("rank", F.lit(1)).drop("_wanted").limit(0)
    first = materialise(look(probed(asked, False)), "list-first")
    by = W.partitionBy(query_id).orderBy("distance", *row_id)
    last = first.withColumn("_place", F.row_number().over(by)).where(F.col("_place") == F.col("_wanted")).select(F.col(query_id).alias("_q"), F.col("distance").alias("_kth"))
    told = asked.join(last, asked[query_id] == last["_q"], "left").drop("_q")
    more = look(probed(told, True))
    ranked = first.unionByName(more).withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= F.col("_wanted")).drop("_wanted")
