"""Category rules of many projects as a table: saving a project's whole list, and the first rule that fits each unit.

Units meet the rules of their project only. Prefixes and parts are tests of the join itself, so pairs that don't fit never
leave it; regular expressions are searched in Arrow batches, as their dialect is Python's. The rules' side is small
and Spark sends it to all executors when it measures it so; otherwise both sides are shuffled by project, and a hot
project is split.

Defined results: rules that are off, blank, of an unknown kind or not a regular expression fit nothing; a null file name is
an empty one; rules of equal priority go by id; units of a null project, and those that no rule fits, have no category.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# What rules look at, and how.
MATCH_ON, KINDS = ("file_name", "unit_title"), ("prefix", "contains", "regex")


def _compiled(pattern: str | None):
    try:
        return re.compile(pattern) if pattern is not None else None
    except re.error:
        return None


def is_pattern(pattern: Column) -> Column:
    """Whether a text is a regular expression."""

    @F.pandas_udf("boolean")
    def fine(patterns: pd.Series) -> pd.Series:
        known = {p: _compiled(p) is not None for p in patterns.unique()}
        return patterns.map(known)

    return fine(pattern)


def found_in(pattern: Column, text: Column) -> Column:
    """Whether a regular expression is found in a text; one that isn't valid never is."""

    @F.pandas_udf("boolean")
    def search(patterns: pd.Series, texts: pd.Series) -> pd.Series:
        known = {p: _compiled(p) for p in patterns.unique()}
        return pd.Series([known[p] is not None and t is not None and known[p].search(t) is not None for p, t in zip(patterns, texts, strict=True)], dtype=bool)

    return search(pattern, text)


def refusal(rules: DataFrame) -> DataFrame:
    """``rules`` with ``refused``: why a rule may not be saved, null for good ones. Regular expressions are checked by the plan itself."""
    odd = (
        F.when(~F.coalesce(F.col("match_on").isin(*MATCH_ON), F.lit(False)), "match_on").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind")
        .when(F.coalesce(X.is_blank(F.col("pattern")), F.lit(True)), "pattern").when(F.coalesce(X.is_blank(F.col("category")), F.lit(True)), "category")
    )
    checked = rules.withColumn("_fine", is_pattern(F.when(F.col("kind") == "regex", F.col("pattern"))))
    return checked.withColumn("refused", F.coalesce(odd, F.when((F.col("kind") == "regex") & ~F.coalesce("_fine", F.lit(False)), "regex"))).drop("_fine")


def put_rules(rules: DataFrame, puts: DataFrame, project: str = "project_id", place: str = "place") -> tuple[DataFrame, DataFrame]:
    """(the rules afterwards, refused puts). A put is the whole list of a project: its rules replace all there are, the place is
    the priority. One bad rule refuses the project's put, and its old rules stay."""
    judged = refusal(puts)
    whole = Window.partitionBy(project)
    judged = judged.withColumn("_bad", F.max(F.col("refused").isNotNull()).over(whole))
    number = F.row_number().over(whole.orderBy(place)) - 1
    good = judged.where("not _bad").withColumn("priority", number.cast("int"))
    saved = good.select(
        F.md5(F.concat_ws("|", F.col(project).cast("string"), F.col("priority").cast("string"))).alias("id"), project, "match_on", "kind", X.strip(F.col("pattern")).alias("pattern"), X.strip(F.col("category")).alias("category"), "enabled", "priority",
    )
    kept = rules.join(saved.select(project).distinct(), project, "left_anti")
    return kept.select(saved.columns).unionByName(saved), judged.where("refused is not null").select(project, place, "refused")


def classify(units: DataFrame, rules: DataFrame, keys: list[str], project: str = "project_id", file_name: str = "file_name", unit_title: str = "unit_title") -> DataFrame:
    """``units`` with ``rule_category`` of the first rule that fits, by priority and id. ``keys`` name a unit."""
    live = rules.where("enabled").where(~X.is_blank(F.col("pattern"))).select(F.col(project).alias("_p"), "match_on", "kind", "pattern", "category", F.struct("priority", "id").alias("_place"))
    texts = units.select(*keys, F.col(project).alias("_own"), F.coalesce(file_name, F.lit("")).alias("_file"), F.col(unit_title).alias("_title"))
    own = F.when(F.col("match_on") == "unit_title", F.col("_title")).otherwise(F.col("_file"))
    fits = F.when(F.col("kind") == "prefix", F.startswith(own, F.col("pattern"))).when(F.col("kind") == "contains", F.contains(own, F.col("pattern"))).otherwise(F.col("kind") == "regex")
    met = texts.join(live, (F.col("_own") == F.col("_p")) & fits).select(*keys, "kind", "pattern", "category", "_place", own.alias("_text"))
    plain = met.where("kind <> 'regex'").drop("_text", "pattern", "kind")
    searched = met.where("kind = 'regex'").where(found_in(F.col("pattern"), F.col("_text"))).drop("_text", "pattern", "kind")
    first = plain.unionByName(searched).groupBy(*keys).agg(F.min_by("category", "_place").alias("rule_category"))
    return units.join(first, keys, "left")
