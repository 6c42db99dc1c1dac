"""One small file that names the current state of a stored thing; replaced by one rename, so readers see a whole state or the one before."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_CURRENT = "CURRENT"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the class of its paths."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def read_text(spark: SparkSession, root: str) -> str | None:
    """What the file of a folder says; null where none was ever written."""
    fs, path = file_system(spark, root)
    if not fs.exists(path(f"{root}/{_CURRENT}")):
        return None
    return spark.read.text(f"{root}/{_CURRENT}", wholetext=True).first()[0]


def switch_text(spark: SparkSession, root: str, text: str) -> None:
    """Write a new file beside the current one and rename it over that."""
    fs, path = file_system(spark, root)
    staged = path(f"{root}/{_CURRENT}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    # Local and HDFS file systems both offer an overwriting rename through FileContext.
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(staged), context.makeQualified(path(f"{root}/{_CURRENT}")), options)


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    text = read_text(spark, root)
    return None if text is None else json.loads(text)


def switch_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    switch_text(spark, root, json.dumps(manifest, sort_keys=True))


def drop_unnamed(spark: SparkSession, root: str, named: set[str]) -> list[str]:
    """Delete the folders directly below ``root`` that are not named, and staged files; gives their names. For the one writer, after a switch."""
    fs, path = file_system(spark, root)
    gone = []
    for status in fs.listStatus(path(root)):
        name = status.getPath().getName()
        if name != _CURRENT and name not in named:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
