"""Sinks: appends, and whole-table replacements by versioned folders.

Parquet has no MERGE. A replaced table is written to a new version folder, and a small
pointer file is moved over the old pointer in one rename; readers follow the pointer, so they
see either the old or the new table. One writer per table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import schemas
from tarnwell.functions.vectors import check_dim
from tarnwell.plans.retrieval import KIND_COLUMNS
from tarnwell.settings import INDEX

_POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current_version(spark: SparkSession, root: str) -> str | None:
    """Folder name the pointer names; null for a table that was never written."""
    lines = _pointer_lines(spark, root)
    return lines[0] if lines else None


def current_note(spark: SparkSession, root: str) -> str | None:
    """What the writer of the current version noted beside it."""
    lines = _pointer_lines(spark, root)
    return lines[1] if len(lines) > 1 else None


def _pointer_lines(spark: SparkSession, root: str) -> list[str]:
    fs, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/{_POINTER}")):
        return []
    return spark.read.text(f"{root}/{_POINTER}", wholetext=True).first()[0].splitlines()


def read_current(spark: SparkSession, root: str, schema) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{version}")


def replace_table(df: DataFrame, root: str, partition_by: list[str] | None = None, note: str | None = None) -> str:
    """Write the next version of a table and switch the pointer, with an optional one-line note, to it."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{version}")
    fs, path = _fs(spark, root)
    staged = path(f"{root}/{_POINTER}.{version}")
    out = fs.create(staged, True)
    out.write(bytearray((version if note is None else f"{version}\n{note}").encode()))
    out.close()
    # Local and HDFS file systems both offer an overwriting rename through FileContext.
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(staged), context.makeQualified(path(f"{root}/{_POINTER}")), options)
    return version


def prepare_keyword_rows(rows: DataFrame, shard_id: int | None = None, dim: int = INDEX.vector_dim) -> DataFrame:
    """Keyword rows in table form: ids as text, vectors of the right length or the job stops."""
    if shard_id is not None:
        rows = rows.withColumn("shard_id", F.lit(shard_id))
    shaped = schemas.align(rows, schemas.KB_KEYWORDS)
    return shaped.withColumns({v: check_dim(v, dim) for _, v in KIND_COLUMNS.values()})


def append_keyword_rows(rows: DataFrame, path: str, shard_id: int | None = None, dim: int = INDEX.vector_dim) -> None:
    """Append to the keyword table, laid out by collection and shard."""
    out = prepare_keyword_rows(rows, shard_id, dim)
    out.repartition("kb_collection_id", "shard_id", F.pmod(F.xxhash64("kbid"), F.lit(8))).write.mode("append").partitionBy(
        "kb_collection_id", "shard_id"
    ).parquet(path)


def append_trace(outcomes: DataFrame, path: str, now) -> None:
    """Append one trace record per outcome."""
    trace_rows(outcomes, now).write.mode("append").parquet(path)


def trace_rows(outcomes: DataFrame, now) -> DataFrame:
    status = F.when(F.col("outcome").isin("inserted", "updated"), "success").otherwise(F.col("outcome"))
    return outcomes.select(
        F.col("doc_key").alias("kbid"), status.alias("status"), now.alias("timestamp"), "reason",
        F.to_json(F.struct(F.col("outcome").alias("operation"), F.col("stage"))).alias("details"),
    )


def append_state_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def write_json_results(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted JSON lines, kept in many files; their names follow the order."""
    df.orderBy(*order).write.mode("errorifexists").json(path)


def report_lines(results: DataFrame) -> DataFrame:
    """One text block per record: doc_id, status, json_valid, response."""
    line, rule = "-" * 40, "-" * 80
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Document ID: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))),
        F.concat(F.lit("Status: "), F.col("status")),
        F.concat(F.lit("Valid JSON: "), F.when(F.col("json_valid"), "True").otherwise("False")),
        F.lit(line), F.coalesce("response", F.lit("")), F.lit(rule),
    )
    return results.orderBy(F.asc_nulls_last("doc_id")).select(block.alias("value"))


def write_text_report(results: DataFrame, path: str) -> None:
    report_lines(results).write.mode("errorifexists").text(path)
