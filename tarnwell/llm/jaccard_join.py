"""N-gram Jaccard join: an R-tree over count vectors inside blocks that no link can cross.

Two documents link when their sets of word shingles have a Jaccard similarity at or above a threshold.

*Blocks.* A census (see ``census``) tells each document in how many documents each of its shingles occurs, as a power of
two. Shingles are ordered by that number, rare ones first, then by hash. Of a set of n shingles, any linked set has
ceil(t * n) in common, so two linked sets share one of the first n - ceil(t * n) + 1 of each. Each of these that occurs
twice is a block that the document joins; most documents join none. Texts that are equal are joined once for all of them.

*Stars.* In each block all members are compared with one member, drawn by hash, so that a block of near copies
becomes a component with as many pairs as it has members.

*R-tree.* What is left are members of a block in different components. The shingles of a set are hashed into groups, the
numbers in the groups are a point, and the points of a block are packed into an R-tree. For two sets the summed minima of
their coordinates bound the overlap from above, and so they do for a set and a node, with the node's largest
coordinates. Pairs that survive the bound are verified on the whole sets. Each member first tries the few candidates with the
highest bounds; most components meet that way. Then all survivors of what is still apart are tried. Members of a block's
largest component are only searched, never search, so what leaves a block grows with the few that stand outside. Blocks
beyond a size are cut into parts that are searched and slices of members that ask; a task holds one of each, and what is sent
grows with the members times the slices of the few outside, not with the square of the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.census import BLOB, Layout, answer, by_segment, grouped_totals
from tarnwell.llm.common import LOWER, WINDOW_BASES, free_name, materialise, salts_of, sizes, text_bytes, text_column, window_hashes, word_digests

#: Groups of the count vector, and how many of them an R-tree coordinate sums up.
GROUPS, FOLD = 256, 4
#: Candidates of a document in a block that are tried before all others.
FIRST_TRIES = 4
#: Members of a block that meet in one task; a larger block is cut into parts of this size.
BLOCK_ROWS = 2_048
#: A block with more members than this, and than a thousandth of all, is dealt out by salts.
HOT_BLOCK = 1_000
#: Children of a node of the R-tree.
FANOUT = 16


class Threshold:
    """A similarity as a fraction, so that no rounding decides a link."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("the similarity must be in 1 to 100 percent")
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def links(self, overlap, n, m):
        return 100 * overlap >= self.percent * (n + m - overlap)


# --- shingles --------------------------------------------------------------------------------


class _Shingles:
    """The distinct shingles of each document of a chunk, sorted inside a document."""

    def __init__(self, table: pa.Table, width: int):
        raw, bounds = text_bytes(table.column("text"))
        first, hashes, _ = word_digests(LOWER[raw], bounds)
        n_words = np.diff(first)
        windows = window_hashes(hashes, width, WINDOW_BASES[0])
        n = len(windows)
        row = np.searchsorted(first, np.arange(n), side="right") - 1
        inside = np.arange(n) + width <= first[row + 1] if n else np.zeros(0, bool)
        keep = np.flatnonzero(inside)
        rows, keys = [row[keep]], [windows[keep]]
        for i in np.flatnonzero((n_words > 0) & (n_words < width)):  # the whole sequence is the only shingle
            part = np.append(hashes[first[i] : first[i + 1]], np.uint64(n_words[i]))
            rows.append(np.array([i]))
            keys.append(window_hashes(part, len(part), WINDOW_BASES[1]))
        rows, keys = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        new = np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])) if len(rows) else np.zeros(0, bool)
        self.row, self.key = rows[new], keys[new]
        self.first = np.searchsorted(self.row, np.arange(table.num_rows + 1))


def _entries(s: _Shingles, apart: np.ndarray, layout: Layout):
    """Distinct short hashes of the documents that take part, in how many of them each is, and each shingle's number (-1: no part)."""
    part = apart[s.row]
    shorts = layout.short(s.key[part])
    distinct, number, counts = np.unique(shorts, return_inverse=True, return_counts=True)
    numbers = np.full(len(part), -1, np.int64)
    numbers[part] = number
    return distinct, counts, numbers


def _merge_counts(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
    """For each hash the power of two at or below the number of documents that have it."""
    parts = [np.frombuffer(k, np.uint32) for k in keys]
    totals = grouped_totals(np.concatenate(parts), np.concatenate([np.frombuffer(x, np.uint32) for x in aux]).astype(np.int64))
    ranks = np.frexp(totals)[1].astype(np.uint8)  # 1 for 1, 2 for 2 and 3, 3 for 4 to 7
    cuts = np.cumsum([0, *map(len, parts)])
    return [ranks[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def count_vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.uint32)


def _taking_part(left: pa.Table, copies: pa.Table) -> np.ndarray:
    """Rows that stand for their text: with a doc_id, not a copy of another, and the first of rows that repeat a doc_id and text."""
    ids = left.column("doc_id").to_pylist()
    seen = set(zip(copies.column("doc_id").to_pylist(), copies.column("digest").to_pylist(), strict=True))
    out = np.zeros(len(ids), bool)
    for i, key in enumerate(zip(ids, left.column("digest").to_pylist(), strict=True)):
        if key[0] is not None and key not in seen:
            out[i] = True
            seen.add(key)
    return out


def shingle_sets(docs: DataFrame, copies: DataFrame, layout: Layout, width: int, threshold: Threshold) -> DataFrame:
    """(doc_id, n_shingles, keys, vector, shingles): the last three only where the document joins a block."""
    chunked = docs.groupBy("chunk")
    dropped = copies.select("chunk", F.lit(-1).alias("segment"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("aux"), "doc_id", "digest")

    def send(key, left, right):
        s = _Shingles(left, width)
        distinct, counts, _ = _entries(s, _taking_part(left, right), layout)
        low = (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        counts = counts.astype(np.uint32)
        pieces = by_segment((distinct >> np.uint64(32)).astype(np.int64), len(low))
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(pieces), pa.int32()), "segment": pa.array([p[0] for p in pieces], pa.int32()),
            "keys": pa.array([low[x:y].tobytes() for _, x, y in pieces], pa.binary()), "aux": pa.array([counts[x:y].tobytes() for _, x, y in pieces], pa.binary()),
        })

    def prefixes(key, left, right):
        known = right.column("segment").to_numpy(zero_copy_only=False)
        copies_here, replies = right.filter(pa.array(known == -1)), right.filter(pa.array(known >= 0))
        s = _Shingles(left, width)
        part = _taking_part(left, copies_here)
        distinct, _, numbers = _entries(s, part, layout)
        ranks = np.zeros(len(distinct), np.uint8)
        by = dict(zip(replies.column("segment").to_pylist(), (x.as_py() for x in replies.column("keys")), strict=True))
        for seg, x, y in by_segment((distinct >> np.uint64(32)).astype(np.int64), len(distinct)):
            ranks[x:y] = np.frombuffer(by[seg], np.uint8)
        keys, vectors, sets = [], [], []
        for i in range(left.num_rows):
            lo, hi = s.first[i], s.first[i + 1]
            if not part[i] or lo == hi:
                keys.append(None), vectors.append(None), sets.append(None)
                continue
            own, rank = s.key[lo:hi], ranks[numbers[lo:hi]]
            p = threshold.prefix(hi - lo)
            if np.count_nonzero(rank == 1) >= p:
                keys.append(None), vectors.append(None), sets.append(None)
                continue
            first = np.lexsort((own, rank))[:p]
            chosen = own[first][rank[first] > 1]
            keys.append(chosen.view(np.int64).tolist() or None)
            vectors.append(count_vector(own).tobytes())
            sets.append(own.tobytes())
        return pa.table({
            "doc_id": left.column("doc_id"), "n_shingles": pa.array(np.diff(s.first), pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64())),
            "vector": pa.array(vectors, pa.binary()), "shingles": pa.array(sets, pa.binary()),
        })

    blobs = chunked.cogroup(dropped.groupBy("chunk")).applyInArrow(send, BLOB)
    told = answer(blobs, _merge_counts).withColumn("doc_id", F.lit(None).cast("long")).withColumn("digest", F.lit(None).cast("long")).unionByName(dropped)
    return chunked.cogroup(told.groupBy("chunk")).applyInArrow(
        prefixes, "doc_id long, n_shingles long, keys array<long>, vector binary, shingles binary"
    )


# --- R-tree ----------------------------------------------------------------------------------


class RTree:
    """Points packed bottom-up; a node keeps the largest coordinate, and the smallest and largest size, of its points."""

    def __init__(self, points: np.ndarray, n: np.ndarray, fanout: int = FANOUT):
        # Neighbours in size, then in where most of their shingles are, lie next to each other.
        self.order = np.lexsort((np.argmax(points, axis=1), n)) if len(n) else np.zeros(0, np.int64)
        self.points, self.n, self.fanout = points[self.order], n[self.order], fanout
        self.levels = [(self.points, self.n, self.n)]
        while len(self.levels[-1][0]) > fanout:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), fanout)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def survivors(self, point: np.ndarray, n: int, threshold: Threshold) -> np.ndarray:
        """The numbers of all points whose bound allows a link with the given one."""
        open_ = np.arange(len(self.levels[-1][0]))
        for level in reversed(range(len(self.levels))):
            top, low, high = self.levels[level]
            bound = np.minimum(top[open_], point).sum(axis=1, dtype=np.int64)
            bound = np.minimum(bound, np.minimum(high[open_], n))
            # The union is smallest where the node's sizes are; the overlap is at most the bound.
            open_ = open_[threshold.links(bound, np.maximum(low[open_], bound), n)]
            if level:
                open_ = (open_[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                open_ = open_[open_ < len(self.levels[level - 1][0])]
        return self.order[open_]


def folded(vectors: np.ndarray) -> np.ndarray:
    """Coordinates of the R-tree: neighbouring groups of the count vectors summed up, which leaves bounds valid."""
    return vectors.reshape(len(vectors), -1, FOLD).sum(axis=2)


def _tree_candidates(threshold: Threshold, most: int | None):
    """(doc_id, candidates) of the members outside the block's main component: others in different components that the bound lets through, at most ``most``."""

    def run(key, table):
        ids, n, comp, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n_shingles", "component", "asks"))
        vectors = np.stack([np.frombuffer(v.as_buffer(), np.uint32) for v in table.column("vector").combine_chunks()])
        points = folded(vectors)
        who, found_by = [], []
        tree_rows = np.flatnonzero(~asks)
        tree = RTree(points[tree_rows], n[tree_rows])
        for q in np.flatnonzero(asks) if len(tree_rows) else ():
            found = tree_rows[tree.survivors(points[q], int(n[q]), threshold)]
            found = found[comp[found] != comp[q]]
            bound = np.minimum(np.minimum(vectors[found], vectors[q]).sum(axis=1, dtype=np.int64), n[found])
            fits = threshold.links(bound, n[found], int(n[q]))
            found, bound = found[fits], bound[fits]
            if most is not None and len(found) > most:
                found = found[np.lexsort((ids[found], -bound / (n[found] + n[q] - bound)))[:most]]
            if len(found):
                who.append(int(ids[q]))
                found_by.append(ids[found].tolist())
        return pa.table({"doc_id": pa.array(who, pa.int64()), "candidates": pa.array(found_by, pa.list_(pa.int64()))})

    return run


def _candidate_pairs(blocks: DataFrame, sets: DataFrame, of: DataFrame, threshold: Threshold, most: int | None) -> DataFrame:
    """Pairs (a, b) of members of a block in different components (node, component) that the bound of the count vectors lets through."""
    named = sets.join(of, sets["doc_id"] == of["node"], "left").select("doc_id", "n_shingles", "vector", F.coalesce("component", "doc_id").alias("component"))
    members = blocks.join(named.select("doc_id", "component"), "doc_id")
    shares = members.groupBy("block", "component").agg(F.count(F.lit(1)).alias("n"))
    open_blocks = shares.groupBy("block").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("inside")).where("parts > 1")
    parts, slices = F.ceil(F.col("members") / BLOCK_ROWS).cast("int"), F.ceil((F.col("members") - F.col("inside")) / BLOCK_ROWS).cast("int")
    left = members.join(open_blocks.select("block", "largest", parts.alias("parts"), slices.alias("slices")), "block")
    outside = F.col("component") != F.col("largest")
    # Every member is searched in its own part, once for each slice of those that ask; members outside the main component ask in all parts.
    searched = left.select("block", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("asks"), "doc_id", "component")
    asking = left.where(outside).select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("doc_id", F.lit(4)), F.col("slices")).cast("int").alias("slice"), F.lit(True).alias("asks"), "doc_id", "component")
    met = searched.unionByName(asking).join(named.select("doc_id", "n_shingles", "vector"), "doc_id")
    found = met.groupBy("block", "part", "slice").applyInArrow(_tree_candidates(threshold, most), "doc_id long, candidates array<long>")
    # The blocks that two documents share give the same candidates; they are put together before they become pairs.
    each = found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("candidates"))).alias("candidates")).select("doc_id", F.explode("candidates").alias("other"))
    return each.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


# --- verification and components --------------------------------------------------------------


def _verify(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"), F.col("vector").alias("vector_a")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"), F.col("vector").alias("vector_b")), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb, va, vb in zip(*(batch.column(c) for c in ("set_a", "set_b", "vector_a", "vector_b")), strict=True):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                bound = int(np.minimum(np.frombuffer(va.as_buffer(), np.uint32), np.frombuffer(vb.as_buffer(), np.uint32)).sum(dtype=np.int64))
                if not threshold.links(min(bound, len(x), len(y)), len(x), len(y)):
                    keep.append(False)
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = len(x) - 1
                keep.append(bool(threshold.links(int(np.count_nonzero(x[at] == y)), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b", "vector_a", "vector_b").mapInArrow(linked, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node that it reaches.

    Large-star and small-star steps in turn; each keeps the components, and all edges end at the smallest node. Rows
    are combined before each shuffle, and nothing but the number of changes reaches the driver.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # Done when no node is both below and above others: all edges then end at the smallest node of a component.
    while not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() or not edges.groupBy("a").count().where("count > 1").isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def linked_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of the documents under links of shingle sets.

    Letters A to Z are lower-cased; words are runs without ASCII white space. Gives one row per input row: ``doc_id``,
    ``n_shingles``, ``component_id`` (smallest doc_id reachable by links, itself included). A null or empty text has no
    shingles and links with nothing; a text of fewer words than ``width`` has its whole sequence as its only shingle. A null
    doc_id links with nothing and has a null component. Rows that share a doc_id are one node. An empty table
    gives no rows. Other columns are not read. Shingles are 61-bit hashes over cryptographic digests of their words; two different
    shingles of w words agree with a chance of 2w / 2^61 at most, whatever the words are.
    """
    threshold = Threshold(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    total_rows, total = sizes(rows, F.col("text"))
    layout = Layout(total)
    rows = rows.withColumn("chunk", layout.chunk()).withColumn("digest", F.xxhash64("text"))

    # Equal texts: one of them stands for all.
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    keyed = rows.where(has_words & F.col("doc_id").isNotNull()).select("doc_id", "chunk", "digest", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    groups = keyed.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
    copies = materialise(keyed.join(groups, "sha").where("doc_id <> least").select("doc_id", "least", "chunk", "digest").distinct(), "copies")

    found = materialise(shingle_sets(rows, copies, layout, width, threshold), "shingles")
    sets = found.where(F.col("shingles").isNotNull()).select("doc_id", "n_shingles", "vector", "shingles", "keys")
    blocks = sets.where(F.col("keys").isNotNull()).select("doc_id", F.explode("keys").alias("block")).distinct()

    draw = F.min(F.struct(F.xxhash64("doc_id", "block").alias("h"), "doc_id"))
    centres = blocks.groupBy("block").agg(draw.alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    centres = materialise(centres.select("block", F.col("c.doc_id").alias("centre"), "members"), "centres")
    hot = F.broadcast(salts_of(centres, ["block"], "members", blocks.count(), HOT_BLOCK))
    salts = F.coalesce("salts", F.lit(1))
    members = blocks.join(hot, "block", "left").select("block", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(6)), salts).cast("int").alias("salt"))
    spread = centres.join(hot, "block", "left").select("block", "centre", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    stars = members.join(spread, ["block", "salt"]).where("doc_id <> centre")
    pairs = stars.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    near = materialise(_verify(pairs, sets, threshold), "links")

    of = materialise(components(near), "components")
    tried = materialise(_verify(_candidate_pairs(blocks, sets, of, threshold, FIRST_TRIES), sets, threshold), "links")
    of = materialise(components(near.unionByName(tried)), "components")
    more = _verify(_candidate_pairs(blocks, sets, of, threshold, None), sets, threshold)

    same_text = copies.select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    final = components(of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(same_text))
    empty = F.col("n_shingles") == 0
    nodes = found.select("doc_id", "n_shingles")
    return nodes.join(final, nodes["doc_id"] == final["node"], "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id")
    )


def keep_smallest(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns; null doc_ids stay."""
    doc = free_name(docs, "join_doc")
    found = linked_components(docs, width, percent)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(doc), "left_anti")
