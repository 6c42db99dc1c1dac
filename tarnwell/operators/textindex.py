"""A stored positional full-text index, and matching against it.

*Stored form.* A folder holds segments; a manifest names those that count. A segment has

* ``postings``: one row per (token, document) with the positions and the label of each, laid out by a hash of the token and sorted
  by token and document in each file; whole numbers are delta-coded by the file format. A token in most documents is cut by
  document numbers over as many files as the segment needs.
* ``frequency``: documents per token, laid out alike.
* ``documents``: number, keys and further narrow columns of each live document. No text is kept.

Documents are numbered in blocks of up to 32,768, the width of Spark's bitmaps. Appending writes a segment and takes earlier
documents of the same keys out of theirs; merging writes the postings of live documents into one.

*Matching.* Only the buckets of wanted tokens are read. The words of an alternative, required and excluded ones, are intersected on bitmaps of
document numbers, block by block; phrases are then tested on the positions in what is left. An alternative that only excludes is
the complement of what it excludes, taken on the same bitmaps.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.functions.text import ColumnLike, col
from tarnwell.operators.fulltext import label_weight, search_document
from tarnwell.session import materialise
from tarnwell.settings import LABEL_WEIGHTS
from tarnwell.sources.manifest import drop_unnamed, read_manifest, switch_manifest

#: Token buckets of an index; fixed when it is made.
BUCKETS = 64
#: Documents of a block, on average; a bitmap has room for twice as many.
BLOCK_DOCS, BLOCK_WIDTH = 16_384, 32_768
#: Postings in a file, on average.
FILE_ROWS = 2_000_000
#: Bytes of text whose words are grouped at once, besides a longer document.
GROUPED_BYTES = 2_000_000
#: Alternatives that meet a block of documents in one group; tasks that the groups are dealt to at most.
SLICE_CLAUSES, MOST_TASKS = 2_048, 1_024
#: Columns of the occurrences by label.
_COUNTS = {label: f"hits_{label}" for label in LABEL_WEIGHTS}
#: Numbers and positions without a dictionary, so that the file format codes their differences.
DELTA_CODED = {"parquet.writer.version": "v2", "parquet.enable.dictionary#doc": "false", "parquet.enable.dictionary#positions.list.element": "false"}


@dataclass(frozen=True)
class TextIndex:
    """An opened index: what the manifest named when it was read."""

    spark: SparkSession
    root: str
    manifest: dict

    @property
    def keys(self) -> list[str]:
        return self.manifest["keys"]

    def _read(self, part: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(s["schemas"][part]).parquet(f"{self.root}/{s[part]}") for s in self.manifest["segments"]])

    def postings(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """(token, doc, positions, labels, bucket) of the wanted buckets, dead documents included."""
        rows = self._read("postings")
        return rows if buckets is None else rows.where(F.col("bucket").isin([int(b) for b in buckets]))

    def frequency(self, buckets: Sequence[int]) -> DataFrame:
        rows = self._read("frequency").where(F.col("bucket").isin([int(b) for b in buckets]))
        return rows.groupBy("token").agg(F.sum("docs").alias("docs"))

    def documents(self) -> DataFrame:
        """(doc, keys, carried columns) of the live documents."""
        return self._read("documents")


def token_bucket(token: ColumnLike, buckets: int) -> Column:
    return F.pmod(F.xxhash64(col(token)), F.lit(buckets)).cast("int")


def open_index(spark: SparkSession, root: str) -> TextIndex:
    manifest = read_manifest(spark, root)
    if manifest is None:
        raise ValueError(f"there is no index in {root}")
    return TextIndex(spark, root, manifest)


def build_index(
    docs: DataFrame, root: str, keys: Sequence[str], fields: dict[str, str], carry: Sequence[str] = (), buckets: int = BUCKETS
) -> TextIndex:
    """Make an index over ``docs``; ``fields`` maps columns to labels A to D in the order in which their tokens are numbered.

    Of rows that repeat their keys one is indexed. Null texts have no tokens. An empty table gives an empty index.
    """
    if read_manifest(docs.sparkSession, root) is not None:
        raise ValueError(f"there is an index in {root} already")
    empty = {"keys": list(keys), "fields": dict(fields), "carry": list(carry), "buckets": buckets, "segments": [], "next_block": 0}
    return _add_segment(TextIndex(docs.sparkSession, root, empty), docs)


def append_documents(index: TextIndex, docs: DataFrame) -> TextIndex:
    """Add documents; earlier ones with the same keys are replaced."""
    return _add_segment(remove_documents(index, docs.select(*index.keys), switch=False), docs)


def remove_documents(index: TextIndex, keys: DataFrame, switch: bool = True) -> TextIndex:
    """Take documents out by their keys. Their postings stay until the next merge; only touched segments are written, without texts."""
    gone = materialise(keys.select(*index.keys).distinct(), "fts-gone")
    segments = []
    for s in index.manifest["segments"]:
        old = index.spark.read.schema(s["schemas"]["documents"]).parquet(f"{index.root}/{s['documents']}")
        if old.join(gone, index.keys, "left_semi").isEmpty():
            segments.append(s)
            continue
        name = f"documents-{uuid.uuid4().hex}"
        old.join(gone, index.keys, "left_anti").write.parquet(f"{index.root}/{name}")
        segments.append(s | {"documents": name})
    changed = TextIndex(index.spark, index.root, index.manifest | {"segments": segments})
    return _switch(changed) if switch else changed


def merge_segments(index: TextIndex) -> TextIndex:
    """Write the postings of live documents as one segment; numbers stay as they are. The folders no longer named are deleted."""
    live = index.documents()
    postings = index.postings().join(live.select("doc"), "doc", "left_semi")
    merged = _write_segment(index, postings, live, index.postings().count())
    return _switch(TextIndex(index.spark, index.root, index.manifest | {"segments": [merged]}), clean=True)


def _switch(index: TextIndex, clean: bool = False) -> TextIndex:
    switch_manifest(index.spark, index.root, index.manifest)
    if clean:
        drop_unnamed(index.spark, index.root, {s[p] for s in index.manifest["segments"] for p in ("postings", "frequency", "documents")})
    return index


def _add_segment(index: TextIndex, docs: DataFrame) -> TextIndex:
    m = index.manifest
    keys, carry = index.keys, m["carry"]
    narrow = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min(F.struct(F.lit(0).alias("_"), *carry)).alias("_carry"))
    narrow = materialise(narrow.select(*keys, *[F.col(f"_carry.{c}").alias(c) for c in carry], "_rows"), "fts-documents")
    size = narrow.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_rows"), F.lit(0)).alias("most")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_DOCS))
    block = F.lit(m["next_block"]).cast("long") + F.pmod(F.xxhash64(*keys, F.lit(3)), F.lit(blocks))
    slot = F.row_number().over(W.partitionBy("_block").orderBy(*keys)) - 1
    checked = F.when(F.col("_slot") < BLOCK_WIDTH, F.col("_slot")).otherwise(F.raise_error(F.lit("a block of documents is too full")))
    numbered = narrow.drop("_rows").withColumn("_block", block).withColumn("_slot", slot)
    numbered = materialise(numbered.withColumn("doc", F.col("_block") * BLOCK_WIDTH + checked).drop("_block", "_slot"), "fts-numbers")

    fields = {c: label for c, label in m["fields"].items()}
    bodies = docs.select(*keys, *[c for c in fields if c not in keys])
    bodies = bodies.dropDuplicates(keys) if size["most"] > 1 else bodies
    told = bodies.join(numbered.select(*keys, "doc"), [*keys])
    hits = search_document(told, fields).select("doc", "fts_fields").mapInArrow(_positions_of_words, "token string, doc long, positions array<int>, labels string")
    postings = hits.withColumn("bucket", token_bucket("token", m["buckets"]))
    # A token and the blank after it have two characters at least.
    chars = reduce(Column.__add__, [F.coalesce(F.length(F.col(c)), F.lit(0)) + 1 for c in fields])
    most = docs.agg(F.coalesce(F.sum(chars.cast("long")), F.lit(0))).first()[0] // 2
    segment = _write_segment(index, postings, numbered, most)
    return _switch(TextIndex(index.spark, index.root, m | {"segments": [*m["segments"], segment], "next_block": m["next_block"] + blocks}))


def _positions_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, doc, positions, labels) of documents (doc, fts_fields): the words are grouped where their document is, without a shuffle."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        fields = batch.column("fts_fields")
        np.add.at(sizes, pc.list_parent_indices(fields).to_numpy(), pc.binary_length(pc.struct_field(fields.flatten(), "tokens")).to_numpy(zero_copy_only=False))
        part = np.cumsum(sizes) // GROUPED_BYTES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), batch.num_rows]
        for first, end in zip(cuts[:-1], cuts[1:]):
            few = batch.slice(first, end - first)
            fields = few.column("fts_fields").flatten()
            split = pc.split_pattern(pc.struct_field(fields, "tokens"), " ")
            words = split.flatten().dictionary_encode()
            if not len(words):
                continue
            field = pc.list_parent_indices(split).to_numpy()
            row = pc.list_parent_indices(few.column("fts_fields")).to_numpy()[field]
            label = np.array([ord(x) for x in pc.struct_field(fields, "label").to_pylist()], np.uint8)[field]
            at = np.arange(len(words)) - np.searchsorted(row, row)
            key = row.astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            bounds = pa.array(np.append(starts, len(order)), pa.int32())
            head = pa.array(order[starts])
            yield pa.RecordBatch.from_arrays([
                words.dictionary.take(words.indices.take(head)), few.column("doc").take(pa.array(row[order[starts]])),
                pa.ListArray.from_arrays(bounds, pa.array(at[order], pa.int32())),
                pa.StringArray.from_buffers(len(starts), bounds.buffers()[1], pa.py_buffer(label[order].tobytes())),
            ], ["token", "doc", "positions", "labels"])


def _write_segment(index: TextIndex, postings: DataFrame, documents: DataFrame, most: int) -> dict:
    """Write postings, of which there are ``most`` at most, and what is told of them. They are laid out as they are made, not written twice."""
    name = uuid.uuid4().hex
    names = {p: f"{p}-{name}" for p in ("postings", "frequency", "documents")}
    files = max(1, math.ceil(most / (FILE_ROWS * index.manifest["buckets"])))
    spread = postings.withColumn("_file", F.pmod(F.xxhash64("doc"), F.lit(files)))
    laid = spread.repartition(index.manifest["buckets"] * files, "bucket", "_file").sortWithinPartitions("bucket", "token", "doc").drop("_file")
    laid.write.options(**DELTA_CODED).partitionBy("bucket").parquet(f"{index.root}/{names['postings']}")
    written = index.spark.read.schema(postings.schema).parquet(f"{index.root}/{names['postings']}")
    counts = written.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("docs"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{index.root}/{names['frequency']}")
    documents.write.parquet(f"{index.root}/{names['documents']}")
    schemas = {p: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) for p, df in (("postings", postings), ("frequency", counts), ("documents", documents))}
    return names | {"schemas": schemas}


# --- matching --------------------------------------------------------------------------------


def _buckets_of(words: DataFrame, buckets: int) -> list[int]:
    return [r["b"] for r in words.select(token_bucket("token", buckets).alias("b")).distinct().collect()]


def _positions(word: Column) -> Column:
    return F.coalesce(F.element_at(F.col("_at"), word)["positions"], F.array().cast("array<int>"))


def _holds(phrase: Column) -> Column:
    """Whether the words of a phrase stand one after another: their positions, moved back by their place, have one in common."""
    words = F.split(phrase, " ")
    later = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i")))
    starts = F.aggregate(later, _positions(words[0]), lambda acc, x: F.array_intersect(acc, F.transform(_positions(x["w"]), lambda p: p - x["i"])))
    return F.size(starts) > 0


def match_index(index: TextIndex, clauses: DataFrame, query_id: str, hits: bool = True, counts: bool = False) -> DataFrame:
    """Matching (query, alternative, document): ``query_id``, ``alternative``, ``terms``, ``doc``, ``hits``, the keys and carried columns.

    ``clauses`` come from ``search_clauses(..., exclude_only=True)``. ``hits`` has (position, term number, label) of every
    occurrence of a term, by position; it is empty for an alternative that only excludes, and absent if not asked for: positions
    are then read for phrases only. With ``counts`` there are, instead of hits, the occurrences of its terms by label (``hits_A`` to
    ``hits_D``), which are counted where words are intersected. A query without clauses, or with a word that no document holds,
    matches nothing.
    """
    clauses = materialise(clauses, "fts-clauses")
    live = index.documents()
    hits = hits and not counts
    positive = _match_required(index, clauses.where(F.size("required") > 0), query_id, hits, counts)
    only_not = clauses.where(F.size("required") == 0)
    if not index.manifest["segments"] or only_not.isEmpty():
        return positive.join(live, "doc")
    rest = _complement(index, only_not, query_id).withColumn("terms", F.array().cast("array<string>"))
    if hits:
        rest = rest.withColumn("hits", F.array().cast(positive.schema["hits"].dataType.simpleString()))
    if counts:
        rest = rest.withColumns({c: F.lit(0) for c in _COUNTS.values()})
    return positive.unionByName(rest.select(*positive.columns)).join(live, "doc")


def _match_required(index: TextIndex, clauses: DataFrame, query_id: str, hits: bool, counts: bool = False) -> DataFrame:
    buckets = index.manifest["buckets"]
    # Words are held if they have postings; only what has several words is looked up by positions.
    several, one = (lambda p: F.contains(p, F.lit(" "))), (lambda p: ~F.contains(p, F.lit(" ")))
    # Clauses are told apart by a number of their own, so that queries may repeat their id.
    of = ["_clause"]
    told = clauses.where(F.col(query_id).isNotNull()).select(
        F.monotonically_increasing_id().alias("_clause"), query_id, "alternative", "terms", F.filter("required", several).alias("_phrases"), F.filter("excluded", several).alias("_no_phrases"), F.filter("excluded", one).alias("_no_words")
    )
    told = materialise(told, "fts-told")
    no_phrase_words = F.flatten(F.transform("_no_phrases", lambda p: F.split(p, " ")))
    words = materialise(told.select(F.explode(F.array_union("terms", F.array_union("_no_words", no_phrase_words))).alias("token")).distinct(), "fts-words")
    wanted_buckets = _buckets_of(words, buckets)
    frequency = materialise(index.frequency(wanted_buckets).join(words, "token", "left_semi"), "fts-frequency")
    # A word no document holds rules its alternative out.
    ruled_out = told.select(*of, F.explode("terms").alias("token")).join(frequency, "token", "left_anti").select(*of).distinct()
    told = materialise(told.join(ruled_out, of, "left_anti"), "fts-possible")
    postings = index.postings(wanted_buckets)
    candidates = materialise(_holding(index, told, postings, counts), "fts-candidates")
    numbers = list(_COUNTS.values()) if counts else []

    look = told if hits else told.where((F.size("_phrases") > 0) | (F.size("_no_phrases") > 0))
    asked = F.array_union("terms", no_phrase_words)
    needed = candidates.select(*of, "doc").join(look.select(*of, F.explode(asked).alias("token")), of)
    pairs = materialise(needed.select("token", "doc").distinct(), "fts-needed")
    # The pairs may be too many to broadcast; then the postings of wanted tokens are sent, not those of all tokens in their buckets.
    asked_for = postings.drop("bucket").join(words, "token", "left_semi")
    evidence = materialise(asked_for.join(pairs, ["token", "doc"]), "fts-evidence")
    shown = needed.join(evidence, ["token", "doc"]).groupBy(*of, "doc").agg(
        F.map_from_entries(F.collect_list(F.struct("token", F.struct("positions", "labels")))).alias("_at")
    )
    checked = shown.join(look, of).where(F.forall("_phrases", _holds) & ~F.exists("_no_phrases", _holds))
    if not hits:
        plain = candidates.join(told.where((F.size("_phrases") == 0) & (F.size("_no_phrases") == 0)), of)
        checked = checked.join(candidates, [*of, "doc"]) if counts else checked
        wanted = [query_id, "alternative", "terms", "doc", *numbers]
        return plain.select(*wanted).unionByName(checked.select(*wanted))
    found = F.flatten(F.transform("terms", lambda t, k: F.transform(
        _positions(t), lambda p, i: F.struct(p.alias("position"), k.alias("term"), F.substring(F.element_at(F.col("_at"), t)["labels"], i + 1, F.lit(1)).alias("label"))
    )))
    return checked.select(query_id, "alternative", "terms", "doc", F.array_sort(found).alias("hits"))


def _holding(index: TextIndex, told: DataFrame, postings: DataFrame, counts: bool = False) -> DataFrame:
    """(_clause, doc) of the documents that hold all ``terms`` and none of ``_no_words``, dead ones included.

    A block of documents and a slice of the alternatives are a group: the postings of the slice's words in the block become bitmaps,
    which are intersected. What is sent is each wanted posting once a slice, not each document of a word once an alternative.
    With ``counts`` a posting is sent with its occurrences by label, and those of the terms of an alternative are added up.
    """
    slices = max(1, math.ceil(told.count() / (SLICE_CLAUSES // 2 if counts else SLICE_CLAUSES)))
    sliced = told.select("_clause", "terms", "_no_words", F.pmod(F.xxhash64("_clause"), F.lit(slices)).cast("int").alias("slice"))
    wanted = sliced.select("slice", F.explode(F.array_union("terms", "_no_words")).alias("token")).distinct()
    block, bit = F.shiftright("doc", 15), F.col("doc").bitwiseAND(BLOCK_WIDTH - 1).cast("int")
    rows = postings.join(wanted.select("token").distinct(), "token", "left_semi")
    # Labels that no field of the index has are not counted.
    labels = [label for label in _COUNTS if counts and label in index.manifest["fields"].values()]
    numbers = [F.length(F.regexp_replace("labels", f"[^{label}]", "")).alias(label) for label in labels]
    sent = F.collect_list(F.struct(bit.alias("bit"), *numbers) if counts else bit)
    held = rows.groupBy("token", block.alias("block")).agg(sent.alias("bits"))
    sent = held.join(wanted, "token")
    met = sliced.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, index.manifest["next_block"] - 1)).cast("long"))))

    def intersect(key, asking: pa.Table, words: pa.Table) -> pa.Table:
        maps, held, amounts = {}, {}, {}
        for token, bits in zip(words.column("token"), words.column("bits")):
            flags = np.zeros(BLOCK_WIDTH, bool)
            places = (bits.values.field("bit") if counts else bits.values).to_numpy()
            flags[places] = True
            maps[token.as_py()] = np.packbits(flags, bitorder="little")
            if counts:
                order = np.argsort(places)
                held[token.as_py()] = places[order]
                amounts[token.as_py()] = [bits.values.field(label).to_numpy()[order] for label in labels]
        at, found, added = [], [], {label: [] for label in labels}
        for i, (terms, without) in enumerate(zip(asking.column("terms").to_pylist(), asking.column("_no_words").to_pylist())):
            if any(t not in maps for t in terms):
                continue
            left = reduce(np.bitwise_and, [maps[t] for t in terms])
            for t in without:
                if t in maps:
                    left = left & ~maps[t]
            if left.any():
                at.append(i)
                found.append(left.tobytes())
                docs = np.flatnonzero(np.unpackbits(left, bitorder="little")) if counts else None
                picked = [(amounts[t], np.searchsorted(held[t], docs)) for t in terms] if counts else []
                for k, label in enumerate(labels):
                    added[label].append(np.sum([of[k][where] for of, where in picked], axis=0, dtype=np.int32).tobytes())
        kept = asking.select(["_clause"]).take(pa.array(at, pa.int64()))
        kept = kept.append_column("block", pa.array([key[1].as_py()] * len(at), pa.int64())).append_column("bits", pa.array(found, pa.binary()))
        for label in labels:
            kept = kept.append_column(label, pa.array(added[label], pa.binary()))
        return kept

    keys = ["slice", "block"]
    # Bitmaps are small and the work on them is not, so groups are not put together by their bytes.
    tasks = min(MOST_TASKS, slices * max(1, index.manifest["next_block"]))
    left = met.repartition(tasks, *keys).groupBy(*keys).cogroup(sent.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(intersect, ", ".join(["_clause long, block long, bits binary", *[f"{label} binary" for label in labels]]))
    found = _documents_of(left, ["_clause"], labels)
    return found.select("_clause", "doc", *[(F.col(label) if label in labels else F.lit(0)).alias(name) for label, name in _COUNTS.items()]) if counts else found


def _documents_of(left: DataFrame, ids: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """(ids, doc) of the bitmaps ``bits`` of blocks, without the documents in ``taken`` if there is such a column.

    ``numbers`` are columns with a whole number of four bytes for each document.
    """
    columns = left.columns

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bits = np.frombuffer(batch.column("bits")[i].as_py(), np.uint8)
                gone = batch.column("taken")[i].as_py() if "taken" in columns else None
                if gone is not None:
                    bits = bits & ~np.frombuffer(gone, np.uint8)
                docs = np.flatnonzero(np.unpackbits(bits, bitorder="little")) + batch.column("block")[i].as_py() * BLOCK_WIDTH
                told = [pa.array([batch.column(c)[i].as_py()] * len(docs), batch.schema.field(c).type) for c in ids]
                told += [pa.array(docs, pa.int64()), *[pa.array(np.frombuffer(batch.column(c)[i].as_py(), np.int32)) for c in numbers]]
                yield pa.RecordBatch.from_arrays(told, [*ids, "doc", *numbers])

    schema = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in ids)
    return left.mapInArrow(flat, ", ".join([f"{schema}, doc long", *[f"{c} int" for c in numbers]]))


def _complement(index: TextIndex, clauses: DataFrame, query_id: str) -> DataFrame:
    """(query, alternative, doc) of the live documents that hold nothing of what an alternative excludes.

    The result has nearly every document for each alternative, so every pair of an alternative and a block of documents is met.
    """
    items = clauses.select(F.struct(query_id, "alternative").alias("_of"), F.posexplode("excluded").alias("alternative", "_item"))
    one = items.select(
        F.to_json("_of").alias("_asked"), "_of", "alternative", F.array("_item").alias("required"), F.array().cast("array<string>").alias("excluded"),
        F.array_distinct(F.split("_item", " ")).alias("terms"),
    )
    named = materialise(one, "fts-excluded")
    held = _match_required(index, named.drop("_of"), "_asked", False).join(named.select("_asked", "_of").distinct(), "_asked")
    block, bit = F.shiftright("doc", 15), F.col("doc").bitwiseAND(BLOCK_WIDTH - 1)

    def bitmaps(rows: DataFrame, *by: str) -> DataFrame:
        return rows.select(*by, "doc").distinct().groupBy(*by, block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits"))

    taken = bitmaps(held.select("_of", "doc"), "_of").withColumnRenamed("bits", "taken")
    live = materialise(bitmaps(index.documents()), "fts-live")
    all_blocks = clauses.select(F.struct(query_id, "alternative").alias("_of")).crossJoin(live)
    left = all_blocks.join(taken, ["_of", "block"], "left")
    flat = left.select(F.col(f"_of.{query_id}").alias(query_id), F.col("_of.alternative").cast("int").alias("alternative"), "block", "bits", "taken")
    return _documents_of(flat, [query_id, "alternative"])


# --- ranking on hits ---------------------------------------------------------------------------


def hit_weights_of_counts() -> Column:
    """``hit_weights`` of matches that were made with ``counts``."""
    return F.round(reduce(Column.__add__, [F.col(name) * F.lit(LABEL_WEIGHTS[label]) for label, name in _COUNTS.items()]), 9)


def hit_weights(hits: ColumnLike, terms: ColumnLike | None = None) -> Column:
    """Sum of the label weights of all hits, from the count of each label, so that equal counts tie exactly."""

    def weight_of(label: str) -> Column:
        return F.size(F.filter(col(hits), lambda h: h["label"] == label)) * F.lit(LABEL_WEIGHTS[label])

    return F.round(reduce(Column.__add__, map(weight_of, LABEL_WEIGHTS)), 9)


def cover_density_of_hits(hits: ColumnLike, terms: ColumnLike) -> Column:
    """Cover density of the hits (position, term, label), by position.

    A cover is a shortest stretch holding every term; it adds the harmonic mean weight of the hits inside, divided by one plus the
    number of other words inside. One sweep keeps, for each term, its last hit; the earliest of these is where a stretch begins.
    """
    none = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("position"), F.lit(0.0).cast("double").alias("before"))
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0.0).cast("double").alias("sum"), F.transform(col(terms), lambda t: none).alias("last"), F.lit(-1).alias("from"),
        F.lit(0.0).cast("double").alias("total"),
    )

    def step(acc: Column, h: Column) -> Column:
        after = acc["sum"] + 1.0 / label_weight(h["label"])
        own = F.struct(acc["i"].alias("i"), h["position"].alias("position"), acc["sum"].alias("before"))
        last = F.transform(acc["last"], lambda x, k: F.when(k == h["term"], own).otherwise(x))
        first = F.array_min(last)
        inside = acc["i"] - first["i"] + 1
        noise = F.greatest(h["position"] - first["position"] - (inside - 1), F.lit(0))
        new = (first["i"] >= 0) & (first["i"] != acc["from"])
        gain = F.when(new, inside / (after - first["before"]) / (1.0 + noise)).otherwise(0.0)
        return F.struct(
            (acc["i"] + 1).alias("i"), after.alias("sum"), last.alias("last"), F.when(new, first["i"]).otherwise(acc["from"]).alias("from"),
            (acc["total"] + gain).alias("total"),
        )

    return F.aggregate(col(hits), start, step, lambda acc: acc["total"])


INDEX_RANKERS = {"hits": hit_weights, "cover": cover_density_of_hits}

assert all(w > 0 for w in LABEL_WEIGHTS.values())
