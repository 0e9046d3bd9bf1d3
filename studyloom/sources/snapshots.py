"""Snapshots of tables as rows of JSON: the full export, what a client starts from, and both as files with a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that never leave.
SECRET_SETTINGS = ("password_hash",)

Tables = dict[str, tuple[DataFrame, list[str]]]


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def section(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``section``, ``key`` (sort key as JSON) and ``row`` (JSON) of a table."""
    return rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*order)).alias("key"), _json(rows.columns).alias("row"))


def exported(tables: Tables) -> Tables:
    """All tables' rows, soft-deleted ones included. Settings that are secret go."""
    return {n: (t.where(~F.col("k").isin(*SECRET_SETTINGS)) if n == "settings" else t, order) for n, (t, order) in tables.items()}


def started(tables: Tables) -> Tables:
    """What a client starts from: live projects and files alone, all rows of the other tables."""
    return exported({n: (t.where("deleted_at is null").drop("deleted_at") if n in ("projects", "files") else t, order) for n, (t, order) in tables.items()})


def export(tables: Tables) -> DataFrame:
    """The full export as rows."""
    return reduce(DataFrame.unionByName, (section(t, n, order) for n, (t, order) in exported(tables).items()))


def bootstrap(tables: Tables) -> DataFrame:
    """A client's start as rows."""
    return reduce(DataFrame.unionByName, (section(t, n, order) for n, (t, order) in started(tables).items()))


def write(tables: Tables, path: str) -> DataFrame:
    """Write tables as lines of JSON under ``path``: a folder for each section, in it a file for each range of keys, sorted. The
    manifest says for each file how many rows it holds, from which key to which (structs as JSON), and their checksum. It is written last, so a
    snapshot without one isn't whole. Returns the manifest."""
    spark, sums = next(iter(tables.values()))[0].sparkSession, []
    for name, (rows, order) in tables.items():
        folder = f"{path}/rows/section={name}"
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(_json(rows.columns).alias("value")).write.text(folder)
        # Keys compare by their types, so they are read from the written rows by the table's schema.
        key = F.struct(*(F.from_json("value", rows.schema)[c].alias(c) for c in order))
        read = spark.read.text(folder).select(F.col("_metadata.file_name").alias("file"), "value", key.alias("key"))
        ends = (F.to_json(f("key"), {"ignoreNullFields": "false"}).alias(n) for f, n in ((F.min, "first"), (F.max, "last")))
        sums.append(read.groupBy("file").agg(*_sums(), *ends).withColumn("section", F.lit(name)))
    manifest = reduce(DataFrame.unionByName, sums)
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return read_manifest(spark, path)


def _sums() -> list[Column]:
    return [F.count("*").alias("rows"), F.sum(F.octet_length("value")).alias("bytes"), F.bit_xor(F.xxhash64("value")).alias("checksum")]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("section string, file string, rows long, bytes long, checksum long, first string, last string").json(f"{path}/manifest")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """``section``, ``file`` and ``row`` (JSON) of everything that was written."""
    return spark.read.text(f"{path}/rows").select("section", F.col("_metadata.file_name").alias("file"), F.col("value").alias("row"))


def damage(spark: SparkSession, path: str) -> DataFrame:
    """Files that aren't what the manifest says: ``section``, ``file`` and ``problem`` (missing, unknown or changed)."""
    there = read_rows(spark, path).withColumnRenamed("row", "value").groupBy("section", "file").agg(*(c.alias(f"now_{n}") for c, n in zip(_sums(), ("rows", "bytes", "checksum"), strict=True)))
    both = read_manifest(spark, path).join(there, ["section", "file"], "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"now_{c}") for c in ("rows", "bytes", "checksum")))
    problem = F.when(F.col("now_rows").isNull(), "missing").when(F.col("rows").isNull(), "unknown").when(~same, "changed")
    return both.select("section", "file", problem.alias("problem")).where("problem is not null")
