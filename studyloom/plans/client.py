"""Queries over a client's own copy of the data: events are its writes, users are its pieces and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sync
from ..session import table

NOW = "2024-03-01"


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are progress, clicks plans, purchases check-ins of a day, errors writes to something else. Some values are of odd types."""
    n, i = F.col("event_id"), F.col("event_id").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    progress = F.concat(F.lit('{"last_pos":'), F.when(n % 4 == 0, quoted(i)).otherwise((n % 50).cast("string")), F.lit(',"recited":'), F.when(n % 5 == 0, "null").when(n % 3 == 0, "true").otherwise("false"), F.lit("}"))
    plan = F.concat(F.lit('{"title":'), quoted(F.concat(F.lit("t"), i)), F.lit(',"k'), (n % 3).cast("string"), F.lit('":'), i, F.lit("}"))
    day = F.concat(F.lit('{"items_json":'), F.when(n % 6 == 0, "7").otherwise(F.concat(F.lit('["a'), i, F.lit('",'), i, F.lit("]"))), F.lit("}"))
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.when(kind == "view", "piece_progress").when(kind == "click", "plan").when(kind == "purchase", "checkin").otherwise("goal").alias("entity"),
        F.when(kind == "purchase", F.date_format(F.date_sub(F.to_date("ts"), (F.col("user_id") % 9).cast("int")), "yyyy-MM-dd")).otherwise(user).alias("entity_id"),
        F.when(kind == "view", progress).when(kind == "purchase", day).otherwise(plan).alias("patch"), "ts", "event_id",
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct()


def client_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _users(spark, sf_dir).where("user_id % 13 <> 0").select(F.col("user_id").alias("id"), (F.col("user_id") % 7).cast("int").alias("last_pos"), F.lit(False).alias("recited"))
    return sync.patched_pieces(pieces, _writes(spark, sf_dir), ["ts", "event_id"])


def client_checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of sign-ups have entries already."""
    days = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.date_format("ts", "yyyy-MM-dd").alias("date")).distinct().select("date", F.array(F.lit("old")).alias("items"), F.lit("2024-01-01").alias("updated_at"))
    return sync.patched_checkins(days, _writes(spark, sf_dir), ["ts", "event_id"], NOW).select("date", F.array_join("items", ",").alias("items"), "updated_at")


def client_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each field of every plan."""
    plans = _users(spark, sf_dir).where("user_id % 11 <> 0").select(F.col("user_id").alias("id"), F.create_map(F.lit("title"), F.lit('"old"'), F.lit("due"), F.lit('"d"')).alias("row"))
    return sync.patched_plans(plans, _writes(spark, sf_dir), ["ts", "event_id"]).select("id", F.explode("row").alias("field", "value"))


def client_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times that a client gives writes made when the events were: ahead of its clock, in whole seconds, as naive UTC."""
    made = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("event_id") % 1000 / 1000)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(sync.client_time(made), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


ORACLES = {
    "client_times": "SELECT event_id, strftime(date_trunc('second', ts + to_milliseconds(event_id % 1000) + INTERVAL 5 SECOND), '%Y-%m-%d %H:%M:%S.000') AS at FROM events",
    "client_pieces": """WITH v AS (SELECT user_id, event_id AS n, ts FROM events WHERE event_type = 'view'), u AS (SELECT DISTINCT user_id FROM events WHERE user_id % 13 <> 0)
SELECT u.user_id AS id, coalesce(arg_max(n % 50, (ts, n)) FILTER (WHERE n % 4 <> 0), u.user_id % 7)::INT AS last_pos, coalesce(arg_max(n % 3 = 0, (ts, n)) FILTER (WHERE n % 5 <> 0), false) AS recited FROM u LEFT JOIN v ON v.user_id = u.user_id GROUP BY u.user_id""",
    "client_checkins": """WITH p AS (SELECT strftime(ts::DATE - (user_id % 9)::INT, '%Y-%m-%d') AS date, event_id AS n, ts FROM events WHERE event_type = 'purchase'),
l AS (SELECT date, arg_max(CASE WHEN n % 6 = 0 THEN '' ELSE 'a' || n || ',' || n END, (ts, n)) AS items FROM p GROUP BY date)
SELECT date, items, '2024-03-01' AS updated_at FROM l UNION ALL SELECT DISTINCT strftime(ts, '%Y-%m-%d'), 'old', '2024-01-01' FROM events WHERE event_type = 'signup' AND strftime(ts, '%Y-%m-%d') NOT IN (SELECT date FROM l)""",
    "client_plans": """WITH u AS (SELECT DISTINCT user_id FROM events WHERE user_id % 11 <> 0), c AS (SELECT user_id, event_id AS n, ts FROM events WHERE event_type = 'click' AND user_id % 11 <> 0),
f AS (SELECT user_id, 'title' AS field, '"t' || n || '"' AS value, ts, n FROM c UNION ALL SELECT user_id, 'k' || n % 3, n::VARCHAR, ts, n FROM c), l AS (SELECT user_id, field, arg_max(value, (ts, n)) AS value FROM f GROUP BY ALL)
SELECT user_id AS id, field, value FROM l UNION ALL SELECT user_id, 'due', '"d"' FROM u UNION ALL SELECT user_id, 'title', '"old"' FROM u WHERE user_id NOT IN (SELECT user_id FROM l)""",
}
QUERIES = {f.__name__: f for f in (client_pieces, client_checkins, client_plans, client_times)}
