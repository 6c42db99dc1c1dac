"""Exact top-k search by inner product: one ball tree over all vectors, branch and bound, one k-th score for all shards.

Vectors become whole numbers. The top of the tree is split on a bounded sample and deals all vectors into shards; each shard is a
ball around its sample's mean, as wide as its farthest vector, and has a ball tree of its own below. A ball with centre c and
radius r holds no vector with a larger inner product with q than q.c + |q| r. The search runs twice. First every query looks
into the most promising leaf of its most promising shard; the k-th best score there is a lower bound of the final one. Then it
goes to the shards whose bound reaches that score, and in each takes the nodes in the order of their upper bounds, starts
from the shared bound, raises it by its own finds, and skips every node that cannot reach it. Ties are looked at too.

Shards that hold more vectors than planned are cut by a hash, the queries of a shard into blocks; a pair of a block and a
part of a shard is one task of bounded size. What leaves a task is k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.llm.common import materialise

#: Vectors in a shard, and queries in a block, on average.
SHARD_ROWS = 8_192
BLOCK_ROWS = 4_096
#: Vectors, the first by a hash, on which the top of the tree is split; for each shard there are so many at least.
SAMPLE_ROWS, SAMPLE_SHARE = 16_384, 16
#: Vectors in a leaf at most.
LEAF_ROWS = 128

FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Balls level by level; the last level has the leaves, each a stretch of ``order``."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        stretches = [(0, len(points))]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # centres, radii, parent of each ball
        parents = [0]
        while True:
            centres = np.stack([points[self.order[a:b]].mean(axis=0) for a, b in stretches])
            radii = np.array([np.sqrt(((points[self.order[a:b]] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(stretches, centres, strict=True)])
            self.levels.append((centres, radii, np.array(parents)))
            if all(b - a <= leaf_rows for a, b in stretches):
                break
            after, parents = [], []
            for k, (a, b) in enumerate(stretches):
                if b - a <= leaf_rows:
                    after.append((a, b))
                    parents.append(k)
                    continue
                own = points[self.order[a:b]]
                far = own[np.argmax(((own - centres[k]) ** 2).sum(axis=1))]
                other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
                middle = (b - a) // 2  # halves along the line between two far points
                self.order[a:b] = self.order[a:b][np.argsort(own @ (other - far), kind="stable")]
                after += [(a, a + middle), (a + middle, b)]
                parents += [k, k]
            stretches = after
        self.leaves = stretches

    def bounds(self, queries: np.ndarray, norms: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Upper bound of each query in each leaf; minus infinity below a ball that cannot reach the k-th score."""
        above = None
        for centres, radii, parents in self.levels:
            reach = norms[:, None] * radii[None, :]
            level = queries @ centres.T + reach
            # Rounding must not lower a bound.
            level += 1e-9 * (np.abs(level) + reach) + 1e-6
            if above is not None:
                level[above[:, parents] == -np.inf] = -np.inf
            level[level < kth[:, None]] = -np.inf
            above = level
        return above


class _Best:
    """The k best (score, smaller id first among equals) of each query so far."""

    def __init__(self, queries: int, k: int, kth: np.ndarray):
        self.k, self.low = k, np.iinfo(np.int64).min
        self.scores = np.full((queries, k), self.low, np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, np.int64)
        self.kth = kth.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries with the vectors ``ids``; the lowest number marks a pair that does not count."""
        hopeful = (scores >= self.kth[rows][:, None]).any(axis=1)
        rows, scores = rows[hopeful], scores[hopeful]
        if not len(rows):
            return
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        best = np.lexsort((all_ids, -np.maximum(all_scores, self.low + 1)), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, best, axis=1)
        self.ids[rows] = np.take_along_axis(all_ids, best, axis=1)
        self.kth[rows] = np.maximum(self.kth[rows], self.scores[rows, -1].astype(float))


class TopTree:
    """Halving planes down to some number of shards, with a centre for each shard."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.depth = max(0, min(shards, len(sample) // SAMPLE_SHARE).bit_length() - 1)
        inner = 2**self.depth - 1
        self.planes, self.limits = np.zeros((inner, sample.shape[1])), np.zeros(inner)
        stretches = [np.arange(len(sample))]
        for level in range(self.depth):
            after = []
            for k, own in enumerate(stretches):
                points = sample[own]
                far = points[np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1))]
                other = points[np.argmax(((points - far) ** 2).sum(axis=1))]
                along = points @ (other - far)
                order = np.argsort(along, kind="stable")
                node = 2**level - 1 + k
                self.planes[node], self.limits[node] = other - far, along[order[len(own) // 2]]
                after += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
            stretches = after
        self.centres = np.stack([sample[own].mean(axis=0) for own in stretches])

    def shards_of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each vector and its distance from the shard's centre."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", points, self.planes[node]) >= self.limits[node])
        shard = node - (2**self.depth - 1)
        return shard, np.sqrt(((points - self.centres[shard]) ** 2).sum(axis=1))

    def bounds(self, queries: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Upper bound of each query in each shard; minus infinity in shards without vectors (a negative radius)."""
        reach = np.sqrt((queries**2).sum(axis=1))[:, None] * radii[None, :]
        bound = queries @ self.centres.T + reach
        bound += 1e-9 * (np.abs(bound) + reach) + 1e-6  # rounding must not lower a bound
        return np.where(radii[None, :] < 0, -np.inf, bound)


def search(query_ids, queries, kth, ids, vectors, k: int, only_first_leaf: bool, leaf_rows: int = LEAF_ROWS, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector id, score) of the k best vectors of one shard that reach the given k-th scores; whole numbers throughout.

    A vector that has the id and the entries of the query, and is marked as the ``first`` of its equals, is the query's own row.
    """
    first = np.ones(len(ids), bool) if first is None else first
    points, asked = vectors.astype(float), queries.astype(float)
    top = max(float(np.abs(points).max(initial=0)), 1.0) * max(float(np.abs(asked).max(initial=0)), 1.0) * max(1, points.shape[1])
    exact = top < 2**53  # products and sums are then exact in doubles, else they are taken in 64-bit numbers
    norms = np.sqrt((asked**2).sum(axis=1))
    tree = BallTree(points, leaf_rows)
    best = _Best(len(asked), k, kth)
    bounds = tree.bounds(asked, norms, best.kth)
    by_bound = np.argsort(-bounds, axis=1, kind="stable")
    everyone = np.arange(len(asked))
    open_ = everyone
    for turn in range(len(tree.leaves)):
        leaf = by_bound[open_, turn]
        alive = (bounds[open_, leaf] >= best.kth[open_]) & (bounds[open_, leaf] > -np.inf)
        open_, leaf = open_[alive], leaf[alive]  # later leaves have lower bounds
        if not len(open_):
            break
        for which in np.unique(leaf):
            rows = open_[leaf == which]
            a, b = tree.leaves[which]
            own = tree.order[a:b]
            if exact:
                scores = np.rint(asked[rows] @ points[own].T).astype(np.int64)
            else:
                scores = queries[rows] @ vectors[own].T
            i, j = np.nonzero((query_ids[rows][:, None] == ids[own][None, :]) & first[own][None, :])
            same = (queries[rows[i]] == vectors[own[j]]).all(axis=1)
            scores[i[same], j[same]] = best.low
            best.add(rows, scores, ids[own])
        if only_first_leaf:
            break
    got = best.scores > best.low
    return np.broadcast_to(everyone[:, None], got.shape)[got], best.ids[got], best.scores[got]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def whole_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, vector, dim) with floor(scale * x) of each component; rows with null or non-finite parts are left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    vector = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.size("embedding").alias("dim"))


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _deal(vectors: DataFrame) -> tuple[DataFrame, dict[int, tuple[TopTree, np.ndarray]]]:
    """The vectors with ``shard`` and ``part``, and for each number of dimensions the tree and the radius of each shard."""
    counts = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}
    sample = vectors.select("dim", "vector", F.xxhash64("vec_id", "vector").alias("draw")).orderBy("draw").limit(SAMPLE_ROWS).collect()
    by_dim: dict[int, list] = {dim: [] for dim in counts}
    for r in sample:
        by_dim[r["dim"]].append(r["vector"])
    trees = {dim: TopTree(np.array(v or [[0] * dim], float).reshape(len(v) or 1, dim), math.ceil(counts[dim] / SHARD_ROWS)) for dim, v in by_dim.items()}

    def assign(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            shard, distance = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points = _matrix(pa.chunked_array([batch.column("vector").take(pa.array(at))]), int(dim)).astype(float)
                shard[at], distance[at] = trees[int(dim)].shards_of(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(distance)], [*batch.schema.names, "shard", "distance"])

    dealt = materialise(vectors.mapInArrow(assign, "vec_id long, vector array<long>, dim int, copies long, shard int, distance double"), "dealt")
    wide = dealt.groupBy("dim", "shard").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radii = {dim: np.full(len(tree.centres), -1.0) for dim, tree in trees.items()}
    for r in wide:
        radii[r["dim"]][r["shard"]] = r["radius"]
    many = dealt.sparkSession.createDataFrame([(r["dim"], r["shard"], math.ceil(r["n"] / SHARD_ROWS)) for r in wide], "dim int, shard int, parts int")
    parted = dealt.join(F.broadcast(many), ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector", F.lit(9)), F.col("parts")).cast("int"))
    return parted.drop("distance"), {dim: (tree, radii[dim]) for dim, tree in trees.items()}


def top_inner_products(embeddings: DataFrame, k: int = 5, query_every: int = 50, scale: float = 256.0) -> DataFrame:
    """The k highest integer inner products of every query vector with all other vectors.

    Queries are the rows whose ``vec_id`` is divisible by ``query_every``; candidates are all rows but the query's own. Gives
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; all candidates if there are fewer than k, ties to the smaller vec_id.
    Rows that repeat a vec_id and vector count each as candidates, but as one query, whose own row is left out once. Different
    vectors of one vec_id are different rows; as queries they share one list. Vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part. Vectors of different length have no product. An empty
    table gives no rows. Scores must fit 64-bit numbers. Other columns are not read.
    """
    rows = whole_vectors(embeddings, scale).groupBy("vec_id", "vector", "dim").agg(F.count(F.lit(1)).alias("copies"))
    dealt, trees = _deal(materialise(rows, "vectors"))
    least = F.lit(np.iinfo(np.int64).min).cast("long")
    asking = dealt.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"), F.col("dim").alias("asked_dim"))
    # No more than k equals of a row, besides a query's own, can be among the k best.
    candidates = dealt.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least("copies", F.lit(k + 1)) - 1)))

    def reached(only_best: bool):
        def run(batches):
            for batch in batches:
                dims, kth = batch.column("asked_dim").to_numpy(), batch.column("kth").to_numpy().astype(float)
                who, shards = [], []
                for dim in np.unique(dims):
                    tree, radii = trees[int(dim)]
                    at = np.flatnonzero(dims == dim)
                    bound = tree.bounds(_matrix(pa.chunked_array([batch.column("asked").take(pa.array(at))]), int(dim)).astype(float), radii)
                    q, s = (np.arange(len(at)), np.argmax(bound, axis=1)) if only_best else np.nonzero((bound >= kth[at][:, None]) & (bound > -np.inf))
                    who.append(at[q])
                    shards.append(s)
                who, shards = np.concatenate([*who, np.zeros(0, np.int64)]), np.concatenate([*shards, np.zeros(0, np.int64)])
                taken = batch.take(pa.array(who.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shards.astype(np.int32))], [*taken.schema.names, "asked_shard"])

        return run

    def finder(only_first_leaf: bool):
        def run(key, left, right):
            dim = key[0].as_py()
            if not left.num_rows or not right.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
            query_ids = left.column("query_id").to_numpy()
            found, ids, scores = search(
                query_ids, _matrix(left.column("asked"), dim), left.column("kth").to_numpy().astype(float),
                right.column("vec_id").to_numpy(), _matrix(right.column("vector"), dim), k, only_first_leaf, first=right.column("copy").to_numpy() == 0,
            )
            return pa.table({"query_id": query_ids[found], "vec_id": ids, "score": scores})

        return run

    def over_shards(queries: DataFrame, only_best: bool) -> DataFrame:
        sent = queries.mapInArrow(reached(only_best), "query_id long, asked array<long>, asked_dim int, kth long, asked_shard int")
        sent = materialise(sent, "asked")
        blocks = sent.groupBy("asked_dim", "asked_shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        blocks = F.broadcast(blocks)  # a row for each shard of the top tree
        parts = F.broadcast(dealt.groupBy(F.col("dim").alias("asked_dim"), F.col("shard").alias("asked_shard")).agg(F.max("parts").alias("parts")))
        left = sent.join(blocks, ["asked_dim", "asked_shard"]).join(parts, ["asked_dim", "asked_shard"])
        all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
        one_part = F.array(F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        left = left.withColumn("asked_part", F.explode(one_part if only_best else all_parts))
        left = left.withColumn("asked_block", F.pmod(F.xxhash64("query_id", F.lit(5)), F.col("blocks")).cast("int"))
        met = blocks.select(F.col("asked_dim").alias("dim"), F.col("asked_shard").alias("shard"), "blocks")
        right = candidates.join(F.broadcast(met), ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = left.select("query_id", "asked", "asked_dim", "kth", "asked_shard", "asked_part", "asked_block")
        right = right.select("vec_id", "vector", "copy", "dim", "shard", "part", "block")
        grouped = left.groupBy("asked_dim", "asked_shard", "asked_part", "asked_block").cogroup(right.groupBy("dim", "shard", "part", "block"))
        return grouped.applyInArrow(finder(only_best), FOUND)

    first = over_shards(asking.withColumn("kth", least), True)
    shared = materialise(_best_of(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth")), "kth")
    bounded = asking.join(shared, "query_id", "left").withColumn("kth", F.coalesce("kth", least))
    return _best_of(over_shards(bounded, False), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
