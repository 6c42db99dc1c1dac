"""Tables that change together: bucketed copy-on-write under one manifest.

The rows of a table belong to owners (an article, a call); an owner's rows lie in one bucket. A commit names, for each table, owners
that go and rows that come; it reads and writes only the buckets of these owners, as new folders, and then switches one
manifest that names the folder of every bucket of every table. Readers open a snapshot, which is one manifest: they see all
tables before a commit or all after it. What a failed commit has written is named by nothing and goes with the next clean-up.
One writer at a time; a commit on a snapshot that is no longer the current one is refused.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell import schemas
from tarnwell.session import materialise
from tarnwell.sources.manifest import drop_unnamed, read_manifest, switch_manifest

_BUCKET = "_bucket"
#: Rows of a file, on average; a bucket with more is several files.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class TableSpec:
    """Columns, the columns that name the owner of a row, how many buckets owners are dealt into, and by which of their columns."""

    schema: T.StructType
    owner: tuple[str, ...]
    buckets: int = 64
    dealt_by: tuple[str, ...] = ()

    def bucket(self) -> Column:
        """The bucket of a row with columns ``_owner_0`` and on."""
        dealt = [f"_owner_{i}" for i, c in enumerate(self.owner) if c in (self.dealt_by or self.owner)]
        return F.pmod(F.xxhash64(*dealt), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Change:
    """Owners whose rows go, and rows that come; rows that come replace all rows of their owners."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


@dataclass(frozen=True)
class Affected:
    """What a commit did to a table: owners that were new, replaced and removed, and rows taken out and put in."""

    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    rows_out: int = 0
    rows_in: int = 0


@dataclass(frozen=True)
class Snapshot:
    """All tables as one manifest names them."""

    store: Store
    manifest: dict

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def note(self) -> str | None:
        return self.manifest.get("note")

    def folders(self, name: str) -> dict[int, str]:
        return {int(b): f for b, f in self.manifest["tables"].get(name, {}).items()}

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets; files of other buckets are not opened."""
        spec, spark = self.store.specs[name], self.store.spark
        wanted = [f for b, f in sorted(self.folders(name).items()) if buckets is None or b in buckets]
        if not wanted:
            return spark.createDataFrame([], spec.schema)
        return spark.read.schema(spec.schema).parquet(*[f"{self.store.root}/{f}" for f in wanted])

    def rows_of(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows that agree with one of the keys in the columns by which the table is dealt; other buckets are not opened."""
        spec = self.store.specs[name]
        dealt = list(spec.dealt_by or spec.owner)
        named = materialise(keys.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_owner_{spec.owner.index(c)}") for c in dealt]).distinct(), f"{name}-wanted")
        buckets = [r["b"] for r in named.select(spec.bucket().alias("b")).distinct().collect()]
        rows = self.read(name, buckets)
        return rows.select(*rows.columns, *self.store._owner(rows, name)).join(named, named.columns, "left_semi").select(*rows.columns)


@dataclass(frozen=True)
class Store:
    """A folder with tables of the given specs."""

    spark: SparkSession
    root: str
    specs: dict[str, TableSpec] = field(default_factory=dict)

    def snapshot(self) -> Snapshot:
        return Snapshot(self, read_manifest(self.spark, self.root) or {"version": 0, "tables": {}})

    def _owner(self, df: DataFrame, name: str) -> list:
        """Owner columns without nulls: a null counts as blank."""
        return [F.coalesce(df[c].cast("string"), F.lit("")).alias(f"_owner_{i}") for i, c in enumerate(self.specs[name].owner)]

    def _write(self, name: str, change: Change, current: Snapshot) -> tuple[dict[int, str], Affected]:
        spec = self.specs[name]
        keys = [f"_owner_{i}" for i in range(len(spec.owner))]
        rows = schemas.align(change.rows, spec.schema) if change.rows is not None else self.spark.createDataFrame([], spec.schema)
        rows = materialise(rows, f"{name}-rows")
        touched = rows.select(*self._owner(rows, name), F.lit(1).alias("comes"))
        if change.gone is not None:
            touched = touched.unionByName(change.gone.select(*self._owner(change.gone, name), F.lit(0).alias("comes")))
        touched = materialise(touched.groupBy(*keys).agg(F.max("comes").alias("comes")).withColumn(_BUCKET, spec.bucket()), f"{name}-touched")
        buckets = [r[_BUCKET] for r in touched.select(_BUCKET).distinct().collect()]
        folders = current.folders(name)
        if not buckets:
            return folders, Affected()
        old = current.read(name, buckets)
        old = old.select(*old.columns, *self._owner(old, name))
        stays = old.join(touched.select(*keys), keys, "left_anti").drop(*keys)
        known = materialise(old.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(touched, keys), f"{name}-known")
        told = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("out"), F.count_if(F.col("comes") == 1).alias("updated"), F.count_if(F.col("comes") == 0).alias("deleted")).first()
        comes = touched.where("comes = 1").count()

        after = stays.unionByName(rows)
        after = after.select(*after.columns, *self._owner(after, name)).withColumn(_BUCKET, spec.bucket())
        n = rows.count()
        kept_rows = sum(1 for b in buckets if b in folders)
        files = max(1, math.ceil((n + (stays.count() if kept_rows else 0)) / (FILE_ROWS * len(buckets))))
        spread = after.withColumn("_file", F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(files))).drop(*keys)
        folder = f"{name}-{uuid.uuid4().hex}"
        spread.repartition(len(buckets) * files, _BUCKET, "_file").drop("_file").write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
        filled = {r[_BUCKET] for r in self.spark.read.schema(T.StructType([*spec.schema.fields, T.StructField(_BUCKET, T.IntegerType())])).parquet(f"{self.root}/{folder}").select(_BUCKET).distinct().collect()}
        nxt = {b: f for b, f in folders.items() if b not in buckets} | {b: f"{folder}/{_BUCKET}={b}" for b in filled}
        return nxt, Affected(comes - told["updated"], told["updated"], told["deleted"], told["out"], n)

    def commit(self, changes: dict[str, Change], on: Snapshot | None = None, note: str | None = None) -> dict[str, Affected]:
        """Apply all changes in one switch; gives what was done to each table. Nothing is seen of a commit that fails."""
        current = on or self.snapshot()
        written = {name: self._write(name, change, current) for name, change in changes.items()}
        if self.snapshot().version != current.version:
            raise RuntimeError("the tables were changed by another writer")
        tables = current.manifest["tables"] | {name: {str(b): f for b, f in folders.items()} for name, (folders, _) in written.items()}
        switch_manifest(self.spark, self.root, {"version": current.version + 1, "tables": tables} | ({"note": note} if note is not None else {}))
        return {name: affected for name, (_, affected) in written.items()}

    def clean(self) -> list[str]:
        """Delete the folders that the current manifest does not name, those of readers of older snapshots included."""
        named = {f.split("/")[0] for folders in self.snapshot().manifest["tables"].values() for f in folders.values()}
        return drop_unnamed(self.spark, self.root, named)
