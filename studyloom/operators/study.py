"""Study reads: pieces and pages of pairs, agenda and daily lists, mastery, cards, streaks, recitation units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

BUCKETS = ("overdue", "today", "later", "unscheduled")


def piece_counts(pieces: DataFrame, pairs: DataFrame, piece: str) -> DataFrame:
    """The pieces with ``pair_count``, zero for those without pairs; pairs are counted before the join."""
    counts = pairs.groupBy(piece).agg(F.count("*").alias("pair_count"))
    return pieces.join(counts, piece, "left").withColumn("pair_count", F.coalesce("pair_count", F.lit(0)))


def pair_page(pairs: DataFrame, piece: str, seq: str, from_seq: int = 0, limit: int = 500) -> DataFrame:
    """For each piece the next ``limit`` pairs (2000 at most) from ``from_seq`` on: a page is the feature here."""
    if not 1 <= limit <= 2000:
        raise ValueError("limit is 1 to 2000")
    by = Window.partitionBy(piece).orderBy(seq)
    return pairs.where(F.col(seq) >= from_seq).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= limit).drop("_n")


def newest(rows: DataFrame, at: str, limit: int = 50) -> DataFrame:
    """The latest rows (200 at most), newest first."""
    return rows.orderBy(F.desc_nulls_last(at)).limit(min(max(1, limit), 200))


def job_list(jobs: DataFrame, status: str | None, project: int | None, limit: int, at: str, order: list[str]) -> DataFrame:
    """The newest jobs (200 at most: a list is a page by design) of a status and project, if given."""
    kept = jobs if status is None else jobs.where(F.col("status") == status)
    kept = kept if project is None else kept.where(F.col("project_id") == project)
    return kept.orderBy(F.desc_nulls_last(at), *order).limit(min(max(1, limit), 200))


def latest_success(jobs: DataFrame, kind: str, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last job of a type that succeeded, for each of ``keys``."""
    last = jobs.where((F.col("status") == "success") & (F.col("type") == kind)).groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return last.select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def projects(rows: DataFrame, include_deleted: bool = False, kind: str | None = None) -> DataFrame:
    """Live projects (or all), of one type if given, newest first."""
    kept = rows if include_deleted else rows.where("deleted_at is null")
    return (kept if kind is None else kept.where(F.col("type") == kind)).orderBy(F.desc("created_at"))


def _bucket(due: Column, status: Column, day: Column) -> Column:
    return F.when(status == "done", "done").when(due.isNull(), "unscheduled").when(due < day, "overdue").when(due == day, "today").otherwise("later")


def agenda(plans: DataFrame, day: str, due: str = "due_date", status: str = "status", order: str = "sort_order") -> DataFrame:
    """Plans with ``days_until``, ``overdue``, ``bucket`` and ``agenda_key``; sort by that key: done last, then overdue,
    today, later and unscheduled, by date and the plan's own order."""
    ref = F.lit(day).cast("date")
    bucket = _bucket(F.col(due), F.col(status), ref)
    rank = F.when(bucket == "done", 99)
    for i, name in enumerate(BUCKETS):
        rank = rank.when(bucket == name, i)
    key = F.struct((F.col(status) == "done").cast("int").alias("done"), rank.alias("rank"), F.coalesce(F.col(due), F.lit("9999-12-31").cast("date")).alias("due"), F.col(order).alias("own"))
    return plans.withColumns({"days_until": F.datediff(F.col(due), ref), "overdue": F.coalesce(F.col(due) < ref, F.lit(False)), "bucket": bucket, "agenda_key": key})


def daily(plans: DataFrame, day: str, keys: list[str], id_: str = "plan_id", due: str = "due_date", status: str = "status", order: str = "sort_order") -> DataFrame:
    """Plans by ``bucket`` (five with done) with their ``place`` in it for each of ``keys``: today's and unscheduled ones by
    their own order, others by date first."""
    bucket = _bucket(F.col(due), F.col(status), F.lit(day).cast("date"))
    rows = plans.withColumn("bucket", bucket)
    date = F.when(~F.col("bucket").isin("today", "unscheduled"), F.coalesce(F.col(due), F.lit("0001-01-01").cast("date")))
    by = Window.partitionBy(*keys, "bucket").orderBy(date, order, id_)
    return rows.withColumn("place", F.row_number().over(by) - 1)


def daily_totals(plans: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    done = F.count_if(F.col(status) == "done")
    return plans.groupBy(*keys).agg(F.count("*").alias("total"), (F.count("*") - done).alias("open"), done.alias("done"))


def open_today(plans: DataFrame, day: str, due: str = "due_date", status: str = "status") -> DataFrame:
    return plans.where((F.col(due) == F.lit(day).cast("date")) & (F.col(status) != "done"))


def mastery(nodes: DataFrame, categories: DataFrame, category: str = "category_id", level: str = "mastery", name: str = "name") -> DataFrame:
    """Counts of no, mid and yes and ``total`` for each category, empty ones kept; nodes of unknown or no category are
    under their id as 未分类. ``ratio``: known (mid and yes) among all, null for empty categories."""
    counts = nodes.groupBy(F.col(category).alias("category_id")).agg(*(F.count_if(F.col(level) == v).alias(v) for v in ("no", "mid", "yes")))
    named = categories.select(F.col(category).alias("_id"), F.col(name).alias("name"))
    joined = counts.join(named, counts.category_id == named._id, "full_outer")
    rows = joined.select(F.coalesce("_id", "category_id").alias("category_id"), F.coalesce("name", F.lit("未分类")).alias("name"), *(F.coalesce(v, F.lit(0)).alias(v) for v in ("no", "mid", "yes")))
    total = F.col("no") + F.col("mid") + F.col("yes")
    return rows.withColumn("total", total).withColumn("ratio", F.when(F.col("total") > 0, (F.col("mid") + F.col("yes")) / F.col("total")))


LEVELS = ("no", "mid", "yes")


def next_mastery(level: Column, correct: Column) -> Column:
    """A step up or down on no, mid, yes; null for other levels."""
    levels = F.array(*map(F.lit, LEVELS))
    place = F.nullif(F.array_position(levels, level), F.lit(0))
    step = F.when(correct, 1).otherwise(-1)
    return F.when(place.isNotNull(), F.element_at(levels, F.greatest(F.lit(1), F.least(F.lit(3), place + step)).cast("int")))


def create_next_mastery(spark: SparkSession, name: str = "next_mastery") -> None:
    """The step as a SQL function of the session: ``next_mastery(level, correct)``."""
    listed = ", ".join(f"'{x}'" for x in LEVELS)
    place = f"array_position(array({listed}), level)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(level STRING, correct BOOLEAN) RETURNS STRING RETURN CASE WHEN {place} > 0 THEN element_at(array({listed}), CAST(greatest(1, least(3, {place} + if(correct, 1, -1))) AS INT)) END")


def mastery_walk(answers: DataFrame, keys: list[str], correct: str, order: list[str], start: str = "no") -> DataFrame:
    """The level after all answers in their order, and how many there were. Steps are maps of the three levels to themselves, and a
    run of steps is such a map again: answers are dealt into ranges of ``order``, each range of a key is folded to one map,
    and only these maps are folded over the ranges. So a key with very many answers is folded by many tasks."""
    step = lambda at, right: F.greatest(F.lit(0), F.least(F.lit(2), at + F.when(right, 1).otherwise(-1)))
    dealt = answers.select(*keys, F.struct(*order, F.col(correct).alias("_ok")).alias("_a")).repartitionByRange("_a").withColumn("_range", F.spark_partition_id())
    same = F.array(*(F.lit(i) for i in range(len(LEVELS))))
    run = F.aggregate(F.array_sort(F.collect_list("_a")), same, lambda m, x: F.transform(m, lambda at: step(at, x["_ok"])))
    folded = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("n"), run.alias("map"))
    level = F.aggregate(F.array_sort(F.collect_list(F.struct("_range", "map"))), F.lit(LEVELS.index(start)), lambda at, x: F.get(x["map"], at))
    return folded.groupBy(*keys).agg(F.sum("n").cast("long").alias("answers"), F.get(F.array(*map(F.lit, LEVELS)), level).alias("mastery"))


def last_quotes(quotes: DataFrame, node: str = "node_id", order: str = "sort_order") -> DataFrame:
    """One quote for each node, the last."""
    return quotes.groupBy(node).agg(F.max_by("quote_text", order).alias("quote_text"), F.max_by("page", order).alias("page"))


def graph_pull(nodes: DataFrame, quotes: DataFrame, node: str = "node_id") -> DataFrame:
    """Every node with its last quote, if it has one."""
    return nodes.join(last_quotes(quotes, node), node, "left")


def flashcards(nodes: DataFrame, quotes: DataFrame, node: str = "node_id", mastery: str | None = None) -> DataFrame:
    """A card for each node with a summary or else a quote: ``question``, ``answer``, ``page``; of one level of mastery if
    given. Nodes with neither text have none."""
    nodes = nodes if mastery is None else nodes.where(F.col("mastery") == mastery)
    joined = nodes.join(last_quotes(quotes, node), node, "left")
    answer = F.coalesce(F.nullif("card_summary", F.lit("")), F.nullif("quote_text", F.lit("")))
    return joined.withColumn("answer", answer).where("answer is not null").withColumnRenamed("name", "question").drop("card_summary", "quote_text")


def search(nodes: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Nodes with the words in any column, in any case; all nodes for no words."""
    if not words:
        return nodes
    return nodes.where(X.any_of([F.coalesce(F.contains(F.lower(c), F.lit(words.lower())), F.lit(False)) for c in columns]))


def layout(nodes: DataFrame, keys: list[str], category: str, order: list[str], category_order: list[str]) -> DataFrame:
    """``column`` and ``row`` of every node: the rank of its category and its place there. The unknown category is last."""
    own = [c for c in category_order if c != category]
    grouped = nodes.select(*keys, category, *own).groupBy(*keys, category)
    columns = grouped.agg(*(F.min(c).alias(c) for c in own)) if own else nodes.select(*keys, category).distinct()
    columns = columns.withColumn("column", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(category).isNull(), *category_order)) - 1)
    placed = nodes.withColumn("row", F.row_number().over(Window.partitionBy(*keys, category).orderBy(*order)) - 1)
    same = [placed[k].eqNullSafe(columns[k]) for k in [*keys, category]]
    joined = placed.join(columns.select(*keys, category, "column"), same)
    return joined.select(*(placed[c] for c in placed.columns), "column")


def project_cards(pieces: DataFrame, project: str, recited: str = "recited", last_pos: str = "last_pos", updated: str = "updated_at") -> DataFrame:
    """``total`` and ``recited`` pieces, rounded mean position and latest study time of each project."""
    studied = F.col(recited) | (F.col(last_pos) > 0)
    mean = F.floor(F.sum(last_pos) / F.count("*") + 0.5).cast("long")
    return pieces.groupBy(project).agg(F.count("*").alias("total"), F.count_if(recited).alias("recited"), mean.alias("avg_pos"), F.max(F.when(studied, F.col(updated))).alias("last_study_at"))


def heat(checkins: DataFrame, keys: list[str], day: str, date: str = "date", items: str = "items", days: int = 30) -> DataFrame:
    """``level`` (0 to 4) of each of the trailing days for each key, days without a check-in included."""
    last = F.lit(day).cast("date")
    levels = checkins.where((F.col(date) > F.date_sub(last, days)) & (F.col(date) <= last)).groupBy(*keys, F.col(date).alias("_d")).agg(F.max(items).alias("_n"))
    people = checkins.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("date"))
    joined = people.join(levels.withColumnRenamed("_d", "date"), [*keys, "date"], "left")
    return joined.select(*keys, "date", F.least(F.coalesce("_n", F.lit(0)), F.lit(4)).cast("int").alias("level"))


def streak(checkins: DataFrame, keys: list[str], day: str, date: str = "date") -> DataFrame:
    """Days in a row with a check-in back from ``day``; 0 where that day has none."""
    ref = F.lit(day).cast("date")
    days = checkins.where(F.col(date) <= ref).select(*keys, F.col(date).alias("_d")).distinct()
    numbered = days.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_d"))) - 1)
    runs = numbered.groupBy(*keys).agg(F.count_if(F.datediff(ref, "_d") == F.col("_n")).cast("int").alias("streak"))
    return checkins.select(*keys).distinct().join(runs, keys, "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def units(pairs: DataFrame, piece: str, order: list[str], block: str = "block_no", paragraphs: bool = True) -> DataFrame:
    """Pairs with ``unit``: neighbours with the same block are one unit, pairs without a block are units of their own."""
    by = Window.partitionBy(piece).orderBy(*order)
    same = F.coalesce(F.col(block) == F.lag(block).over(by), F.lit(False)) if paragraphs else F.lit(False)
    return pairs.withColumn("_new", (~same).cast("int")).withColumn("unit", (F.sum("_new").over(by) - 1).cast("int")).drop("_new")


def unit_rows(with_units: DataFrame, piece: str, order: list[str], seq: str = "seq") -> DataFrame:
    """One row for each unit: text of both sides (parts trimmed, blank ones left out), first page, last place."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(seq).alias("_s"), X.strip(F.col("zh")).alias("_zh"), X.strip(F.col("en")).alias("_en"), F.col("loc_page").alias("_page"))))
    text = lambda c, gap: F.array_join(F.filter(F.col(f"_p.{c}"), lambda t: t != ""), gap)
    rows = with_units.groupBy(piece, "unit").agg(parts.alias("_p"))
    return rows.select(piece, "unit", text("_zh", "").alias("zh"), text("_en", " ").alias("en"), F.get(F.filter("_p._page", lambda p: p.isNotNull()), F.lit(0)).alias("page"), F.array_max("_p._s").alias("last_seq"))


def unit_progress(with_units: DataFrame, pieces: DataFrame, piece: str, seq: str = "seq", last_pos: str = "last_pos", block: str = "block_no") -> DataFrame:
    """``units``, ``done_units``, ``current_unit`` (the first not done, else the last) and whether paragraphs can be used."""
    ends = with_units.groupBy(piece, "unit").agg(F.max(seq).alias("_last"), F.bool_and(F.col(block).isNotNull()).alias("_known"))
    at = pieces.select(piece, last_pos)
    done = F.col("_last") < F.col(last_pos)
    sums = ends.join(at, piece).groupBy(piece).agg(F.count("*").cast("int").alias("units"), F.count_if(done).cast("int").alias("done_units"), F.coalesce(F.min(F.when(~done, F.col("unit"))), F.max("unit")).cast("int").alias("current_unit"), F.bool_and("_known").alias("paragraph_usable"))
    return sums


def position_after_reveal(last_pos: Column, last_seq: Column) -> Column:
    return F.greatest(last_pos, last_seq + 1)


def clamp_position(last_pos: Column, pairs: Column) -> Column:
    """A place rounded into 0 to the number of pairs; 0 for null."""
    return F.coalesce(F.least(F.greatest(F.floor(last_pos + 0.5), F.lit(0)), pairs), F.lit(0)).cast("long")
