"""Queries over plans, mastery, cards, check-ins and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import study
from ..session import table

DAY, LAST_DAY = "1998-01-01", "2024-01-30"


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans; every tenth has no date."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "doing").otherwise("todo")
    due = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("project_id"), due.alias("due_date"), status.alias("status"), (F.col("o_orderkey") % 7).alias("sort_order"))


def agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = study.agenda(_plans(spark, sf_dir), DAY)
    return rows.select("plan_id", "days_until", "overdue", "bucket", F.col("agenda_key.rank").alias("rank"))


def daily_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.daily(_plans(spark, sf_dir), DAY, ["project_id"]).select("project_id", "bucket", "place", "plan_id")


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.daily_totals(_plans(spark, sf_dir), ["project_id"])


def open_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.open_today(_plans(spark, sf_dir), DAY).select("plan_id", "project_id")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    level = F.when(F.col("p_size") % 3 == 0, "no").when(F.col("p_size") % 3 == 1, "mid").otherwise("yes")
    summary = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, "")
    return part.select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("category_id"), F.col("p_name").alias("name"), summary.alias("card_summary"), level.alias("mastery"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return lines.select(F.col("l_partkey").alias("node_id"), F.concat_ws(" ", "l_returnflag", F.col("l_orderkey").cast("string")).alias("quote_text"), F.col("l_linenumber").alias("page"), F.struct("l_orderkey", "l_linenumber", "l_returnflag").alias("sort_order"))


def mastery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By brand; the brands that aren't listed are unknown categories."""
    part = table(spark, sf_dir, "part")
    brands = part.where("p_brand not like '%3'").select(F.col("p_brand").alias("category_id")).distinct()
    types = part.select(F.col("p_type").alias("category_id")).distinct()  # categories without nodes
    return study.mastery(nodes(spark, sf_dir), brands.unionByName(types).withColumn("name", F.upper("category_id")))


def mastery_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase', 'error')").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("correct"))
    return study.mastery_walk(answers, ["user_id"], "correct", ["ts", "event_id"])


def mastery_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each answer leads from a level, by the SQL function; every seventh level is unknown."""
    study.create_next_mastery(spark)
    level = F.when(F.col("event_id") % 7 != 6, F.element_at(F.array(*map(F.lit, study.LEVELS)), (F.col("event_id") % 3 + 1).cast("int"))).otherwise("none")
    answers = table(spark, sf_dir, "events").select("event_id", level.alias("level"), (F.col("event_type") != "error").alias("correct"))
    return answers.select("event_id", F.expr("next_mastery(level, correct)").alias("by_name"), study.next_mastery(F.col("level"), F.col("correct")).alias("by_column"))


def flashcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.flashcards(nodes(spark, sf_dir), quotes(spark, sf_dir)).select("node_id", "question", "answer", "page", "mastery")


def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.search(nodes(spark, sf_dir), "ECON", ["name", "card_summary"]).select("node_id", "name")


def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each size of part."""
    parts = nodes(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("project_id")), "node_id")
    return study.layout(parts, ["project_id"], "category_id", ["node_id"], ["category_id"]).select("project_id", "node_id", "column", "row")


def project_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), (F.col("o_orderstatus") == "F").alias("recited"), (F.col("o_orderkey") % 9).alias("last_pos"), F.col("o_orderdate").cast("date").alias("updated_at"))
    return study.project_cards(pieces, "project_id")


def _checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')")
    return events.groupBy("user_id", F.col("ts").cast("date").alias("date")).agg(F.count("*").alias("items"))


def heat30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.heat(_checkins(spark, sf_dir), ["user_id"], LAST_DAY)


def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.streak(_checkins(spark, sf_dir), ["user_id"], LAST_DAY)


_PLANS = """plans AS (SELECT o_orderkey AS plan_id, o_custkey AS project_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END AS due_date,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'doing' ELSE 'todo' END AS status, o_orderkey % 7 AS sort_order FROM orders)"""
_BUCKET = f"CASE WHEN status = 'done' THEN 'done' WHEN due_date IS NULL THEN 'unscheduled' WHEN due_date < DATE '{DAY}' THEN 'overdue' WHEN due_date = DATE '{DAY}' THEN 'today' ELSE 'later' END"
_NODES = """nodes AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS category_id, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN '' END AS card_summary,
  CASE p_size % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'mid' ELSE 'yes' END AS mastery FROM part)"""
_CHECKINS = "checkins AS (SELECT user_id, ts::DATE AS date, count(*) AS items FROM events WHERE event_type IN ('purchase', 'click') GROUP BY ALL)"
ORACLES = {
    "agenda": f"WITH {_PLANS}, b AS (SELECT *, {_BUCKET} AS bucket FROM plans) SELECT plan_id, datediff('day', DATE '{DAY}', due_date)::INT AS days_until, coalesce(due_date < DATE '{DAY}', false) AS overdue, bucket, CASE bucket WHEN 'done' THEN 99 WHEN 'overdue' THEN 0 WHEN 'today' THEN 1 WHEN 'later' THEN 2 ELSE 3 END AS rank FROM b",
    "daily_todo": f"WITH {_PLANS}, b AS (SELECT *, {_BUCKET} AS bucket FROM plans) SELECT project_id, bucket, (row_number() OVER (PARTITION BY project_id, bucket ORDER BY CASE WHEN bucket NOT IN ('today', 'unscheduled') THEN coalesce(due_date, DATE '0001-01-01') END, sort_order, plan_id) - 1)::INT AS place, plan_id FROM b",
    "daily_totals": f"WITH {_PLANS} SELECT project_id, count(*) AS total, count(*) FILTER (WHERE status <> 'done') AS open, count(*) FILTER (WHERE status = 'done') AS done FROM plans GROUP BY project_id",
    "open_today": f"WITH {_PLANS} SELECT plan_id, project_id FROM plans WHERE due_date = DATE '{DAY}' AND status <> 'done'",
    "mastery_stats": f"""WITH {_NODES}, c AS (SELECT DISTINCT p_brand AS id, upper(p_brand) AS name FROM part WHERE p_brand NOT LIKE '%3' UNION ALL SELECT DISTINCT p_type, upper(p_type) FROM part),
n AS (SELECT category_id, count(*) FILTER (WHERE mastery = 'no') AS no, count(*) FILTER (WHERE mastery = 'mid') AS mid, count(*) FILTER (WHERE mastery = 'yes') AS yes FROM nodes GROUP BY ALL)
SELECT *, no + mid + yes AS total, CASE WHEN no + mid + yes > 0 THEN (mid + yes) / (no + mid + yes) END AS ratio FROM (SELECT coalesce(id, category_id) AS category_id, coalesce(name, '未分类') AS name, coalesce(no, 0) AS no, coalesce(mid, 0) AS mid, coalesce(yes, 0) AS yes FROM n FULL JOIN c ON id = category_id)""",
    "mastery_walk": """SELECT user_id, len(l) AS answers, ['no', 'mid', 'yes'][list_reduce(list_prepend(0, l), lambda a, x: greatest(0, least(2, a + x))) + 1] AS mastery FROM
  (SELECT user_id, list(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END ORDER BY ts, event_id) AS l FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY user_id)""",
    "mastery_steps": """SELECT event_id, up AS by_name, up AS by_column FROM (SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_type = 'error' THEN ['no', 'no', 'mid'][event_id % 3 + 1] ELSE ['mid', 'yes', 'yes'][event_id % 3 + 1] END AS up FROM events)""",
    "flashcards": f"""WITH {_NODES}, q AS (SELECT l_partkey, arg_max(l_returnflag || ' ' || l_orderkey, (l_orderkey, l_linenumber, l_returnflag)) AS quote, arg_max(l_linenumber, (l_orderkey, l_linenumber, l_returnflag)) AS page FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT node_id, name AS question, coalesce(nullif(card_summary, ''), quote) AS answer, page, mastery FROM nodes LEFT JOIN q ON l_partkey = node_id WHERE coalesce(nullif(card_summary, ''), quote) IS NOT NULL""",
    "node_search": f"WITH {_NODES} SELECT node_id, name FROM nodes WHERE contains(lower(name), 'econ') OR coalesce(contains(lower(card_summary), 'econ'), false)",
    "graph_layout": f"WITH {_NODES}, n AS (SELECT p_size AS project_id, nodes.* FROM nodes JOIN part ON p_partkey = node_id), c AS (SELECT project_id, category_id, (row_number() OVER (PARTITION BY project_id ORDER BY category_id IS NULL, category_id) - 1)::INT AS col FROM (SELECT DISTINCT project_id, category_id FROM n)) SELECT n.project_id, node_id, col AS \"column\", (row_number() OVER (PARTITION BY n.project_id, n.category_id ORDER BY node_id) - 1)::INT AS \"row\" FROM n JOIN c ON c.project_id = n.project_id AND c.category_id IS NOT DISTINCT FROM n.category_id",
    "project_card": "SELECT o_custkey AS project_id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS recited, floor(sum(o_orderkey % 9) / count(*) + 0.5)::BIGINT AS avg_pos, max(o_orderdate::DATE) FILTER (WHERE o_orderstatus = 'F' OR o_orderkey % 9 > 0) AS last_study_at FROM orders GROUP BY 1",
    "streak": f"WITH {_CHECKINS}, n AS (SELECT user_id, datediff('day', date, DATE '{LAST_DAY}') AS back, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) - 1 AS i FROM checkins WHERE date <= DATE '{LAST_DAY}') SELECT user_id, coalesce((SELECT count(*) FROM n WHERE n.user_id = u.user_id AND back = i), 0)::INT AS streak FROM (SELECT DISTINCT user_id FROM checkins) u",
}
ORACLES["heat30"] = f"""WITH {_CHECKINS}, days AS (SELECT user_id, d::DATE AS date FROM (SELECT DISTINCT user_id FROM checkins) CROSS JOIN generate_series(DATE '{LAST_DAY}' - INTERVAL 29 DAY, DATE '{LAST_DAY}', INTERVAL 1 DAY) AS g(d))
SELECT user_id, date, least(coalesce(items, 0), 4)::INT AS level FROM days LEFT JOIN checkins USING (user_id, date)"""
QUERIES = {f.__name__: f for f in (agenda, daily_todo, daily_totals, open_today, mastery_stats, mastery_walk, mastery_steps, flashcards, node_search, graph_layout, project_card, heat30, streak)}
ORACLES["graph_pull"] = f"""WITH {_NODES}, q AS (SELECT l_partkey, arg_max(l_returnflag || ' ' || l_orderkey, (l_orderkey, l_linenumber, l_returnflag)) AS quote_text, arg_max(l_linenumber, (l_orderkey, l_linenumber, l_returnflag)) AS page FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)
SELECT node_id, category_id, quote_text, page FROM nodes LEFT JOIN q ON l_partkey = node_id"""
ORACLES["mastered_cards"] = ORACLES["flashcards"].replace("SELECT node_id, name AS question, coalesce(nullif(card_summary, ''), quote) AS answer, page, mastery FROM", "SELECT node_id, name AS question, coalesce(nullif(card_summary, ''), quote) AS answer FROM") + " AND mastery = 'mid'"
