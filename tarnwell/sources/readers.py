"""Readers of the source tables and files; scopes become pushed-down filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell import schemas
from tarnwell.functions.text import clean_content
from tarnwell.operators.shards import shard_ids


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A table in any format Spark reads; a JDBC source is given by its options."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Spread a text table that comes in fewer splits than there are cores.

    A single small file is one task, and its text work would run on one core. A table with
    enough splits is left as it is: at scale no text is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) * 4 < cores else df


def source_documents(documents: DataFrame, collection: str, org: str | None = None) -> DataFrame:
    """Live documents of one collection: six columns."""
    rows = documents.where((F.col("knowledgebase_collection_id") == collection) & ~F.col("is_deleted"))
    if org:
        rows = rows.where(F.col("org_id") == org)
    return rows.select("id", "number", "updated_at", "content", "name", F.col("knowledgebase_collection_id").alias("kb_collection_id"))


def index_state(summaries: DataFrame, collection: str | None = None) -> DataFrame:
    rows = summaries.where(F.col("kb_collection_id") == collection) if collection else summaries
    return rows.where(F.trim("doc_id") != "").select("doc_id", "updated_at")


def read_shard_ids(registry: DataFrame, collection: str | None = None) -> DataFrame:
    return shard_ids(registry.where(F.col("kb_collection_id") == collection) if collection else registry)


def read_kb_docs(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """Articles of a JSON array file; rows without key or body are dropped."""
    raw = spark.read.schema("KB_number string, name string, processed_content string").option("multiLine", True).json(path)
    rows = raw.select(F.trim("KB_number").alias("doc_key"), F.col("name").alias("title"), clean_content("processed_content", max_chars).alias("content"))
    return rows.where((F.col("doc_key") != "") & (F.trim("content") != ""))


def read_labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(
        "KB_number string, name string, generic_queries array<string>, specific_queries array<string>"
    ).option("multiLine", True).json(path)
    return labelled_cases(raw)


def labelled_cases(labelled: DataFrame) -> DataFrame:
    """One case per query of an article's generic and specific lists."""
    def cases(column: str, kind: str) -> DataFrame:
        return labelled.select(
            F.col("KB_number").alias("expected_kb"), F.coalesce("name", F.concat(F.lit("KB_"), F.col("KB_number"))).alias("kb_name"),
            F.lit(kind).alias("query_type"), F.explode(column).alias("query"),
        )

    return cases("generic_queries", "generic").unionByName(cases("specific_queries", "specific"))


def read_config_dir(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per file, in file name order."""
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json")
    return reader.json(path).select("*", F.col("_metadata.file_name").alias("file_name")).orderBy("file_name")


def agent_configs(agents: DataFrame, agent_type: str, config_schema: str) -> DataFrame:
    """Agents of one type, newest first, with the JSON config as a struct."""
    rows = agents.where(F.col("agent_type") == agent_type).orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("config", F.from_json("config", config_schema))


def read_job_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JOBS).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def read_summaries(summaries: DataFrame, collection: str | None = None, shard: int | None = None) -> DataFrame:
    from tarnwell.plans.retrieval import scope_filter

    return scope_filter(summaries, collection, shard).select("doc_id", "summary", "content").orderBy("doc_id")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole HTML files as pages; a parquet table of pages is read as it is."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )
