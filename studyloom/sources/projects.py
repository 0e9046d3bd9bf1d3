"""Tables of many projects, of which some are replaced: pieces saved under their guard, and whole graphs.

A table is dealt into parts by the hash of the project. A write reads the parts of the touched projects alone and overwrites
these (dynamic partition overwrite), so all other parts are neither read nor written, and a job that runs again after a
lost driver leaves the same rows. Every part that was written holds a mark besides its rows, so that one whose last project went
is overwritten, too.
"""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..operators import persistence
from ..session import stored

PARTS = 64
#: Tasks that may share a part's rows when pieces are saved; a piece's rows are in one of them.
SHARES = 16
_OWN = ("_part", "_mark")


def part_of(project: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(project), F.lit(parts)).cast("int")


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows of a table; none if ``schema`` is given and nothing was written yet."""
    try:
        return spark.read.parquet(path).where("not _mark").drop(*_OWN)
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)


def replace(path: str, rows: DataFrame, touched: DataFrame, project: str = "project_id", parts: int = PARTS) -> None:
    """All rows of the ``touched`` projects (distinct values) become those of ``rows``, which are theirs."""
    spark = rows.sparkSession
    dealt = rows.withColumns({"_part": part_of(F.col(project), parts), "_mark": F.lit(False)})
    own = sorted(r[0] for r in touched.select(part_of(F.col(project), parts)).distinct().collect())  # ``parts`` at most
    if not own:
        return
    marks = spark.createDataFrame([(p, True) for p in own], "_part int, _mark boolean")
    written = dealt.unionByName(marks, allowMissingColumns=True)
    with suppress(AnalysisException):  # nothing is stored yet
        written = written.unionByName(_rows_of(spark, path, own).join(touched.select(project).distinct(), project, "left_anti").select(dealt.columns))
    _overwrite(path, written.hint("rebalance", "_part"))


def _rows_of(spark: SparkSession, path: str, own: list[int]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("_part").isin(own) & ~F.col("_mark"))


def _overwrite(path: str, rows: DataFrame) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)


def save_pieces(path: str, staged: DataFrame, rows: DataFrame, keys: list[str], project: str = "project_id", edited: str = "manually_edited", overwrite: bool = False) -> DataFrame:
    """Save the pairs ``rows`` of the pieces ``staged`` (``keys`` and the project, ``ok``: they passed the gate). Pieces with hand edits
    are left alone unless ``overwrite``. Returns the outcome of each piece.

    Stored rows, new rows and the pieces that are taken meet by one shuffle, and are written from it."""
    spark = rows.sparkSession
    existing = read(spark, path, rows.schema)
    edits = existing.groupBy(*keys).agg(F.count_if(edited).alias("manual_edits"), F.min(project).alias("_low"), F.max(project).alias("_high"))
    # What is stored changes below, so the decisions are written first.
    decided = stored(persistence.outcomes(staged, edits, keys, overwrite, also=(F.min("_low").alias("_low"), F.max("_high").alias("_high"))), "outcomes")
    taken = decided.where(F.col("outcome").isin("created", "replaced")).dropna(subset=keys)
    touched = taken.select(project).distinct()
    # A project of each part, ``PARTS`` at most.
    own = touched.groupBy(part_of(F.col(project)).alias("_part")).agg(F.min(project).alias(project)).collect()
    if own:
        piece = list(dict.fromkeys([project, *keys]))
        places = taken.select(*piece)
        # Pieces that are stored in other projects, too, also leave those of them that are touched.
        strayed = taken.where((F.col("_low") != F.col(project)) | (F.col("_high") != F.col(project)))
        if not strayed.isEmpty():
            places = places.unionByName(existing.join(strayed.select(*keys).distinct(), keys, "left_semi").join(touched, project, "left_semi").select(*piece).distinct())
        there = existing
        with suppress(AnalysisException):  # nothing is stored yet
            there = _rows_of(spark, path, [r["_part"] for r in own]).select(rows.columns)
        marks = spark.createDataFrame([(r[project],) for r in own], touched.schema)
        met = [df.withColumn("_from", F.lit(i)) for i, df in enumerate((there, rows, places, marks))]
        every = met[0].unionByName(met[1]).unionByName(met[2], allowMissingColumns=True).unionByName(met[3], allowMissingColumns=True)
        # What rows are dealt by is made again behind the shuffle instead of moved.
        dealt = {"_part": part_of(F.col(project)), "_share": F.pmod(F.hash(*keys), F.lit(SHARES))}
        every = every.repartition(*dealt.values()).withColumns(dealt)
        every = every.withColumn("_taken", F.max(F.col("_from") == 2).over(Window.partitionBy(*dealt, *piece))).withColumn("_mark", F.col("_from") == 3)
        kept = F.col("_mark") | F.when(F.col("_taken"), F.col("_from") == 1).otherwise(F.col("_from") == 0)
        _overwrite(path, every.where(kept).select(*rows.columns, "_mark", "_part"))
    return decided.drop("_low", "_high")


def save_graph(path: str, tables: dict[str, DataFrame], drafts: DataFrame, project: str = "project_id") -> DataFrame:
    """Replace the whole graphs of projects: every table of ``tables`` (with the project's column) under its name. ``drafts``: the projects, with
    ``file_id``. A draft without nodes or without a file replaces nothing. Returns ``outcome`` and ``reason`` of each draft."""
    some = tables["nodes"].select(project).distinct().withColumn("_some", F.lit(True))
    judged = drafts.join(some, project, "left").withColumn("reason", F.when(F.col("_some").isNull(), "graph_empty").when(F.coalesce("file_id", F.lit("")) == "", "graph_no_file"))
    judged = stored(judged.withColumn("outcome", F.when(F.col("reason").isNull(), "replaced").otherwise("rejected")).drop("_some"), "drafts")
    touched = judged.where("reason is null").select(project)
    for name, rows in tables.items():
        replace(f"{path}/{name}", rows.join(touched, project, "left_semi"), touched, project)
    return judged
