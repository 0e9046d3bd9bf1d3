"""Queries over accounts of jobs, offline writes, stored rows and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph, jobs, persistence, study, sync
from ..session import dealt, table
from ..sources import documents as D
from ..sources import snapshots
from . import forms as S
from . import pieces, work

NOW = "2024-01-31 12:00:00"
_KINDS = ("recite_align", "graph_extract", "export")
_STATUSES = ("queued", "running", "success", "failed", "cancelled", "interrupted")


def _pick(values: tuple[str, ...], number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of their customers' projects."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("project_id"), _pick(_STATUSES, F.col("o_orderkey")).alias("status"), _pick(_KINDS, F.col("o_custkey")).alias("type"),
        F.col("o_orderdate").alias("updated_at"), (F.col("o_orderkey") % 11).alias("done"), (F.col("o_orderkey") % 3).alias("failed"), (F.col("o_orderkey") % 17).alias("total"),
    )


def job_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cancel, resume and a restart make of every job, and its percent when it ends."""
    rows = _jobs(spark, sf_dir)
    status = F.col("status")
    moved = rows.select("job_id", *(jobs.transition(status, F.lit(a)).alias(a) for a in ("cancel", "resume")), jobs.finished(status, F.col("done"), F.col("failed"), F.col("total")).alias("percent"))
    return moved.join(jobs.recovered(rows).select("job_id", F.col("status").alias("restarted")), "job_id")


def unit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of more than ten thousand units: a unit for each event."""
    rows = table(spark, sf_dir, "events").select(jobs.unit_key(F.col("event_id"), F.lit("t")).alias("unit_key"))
    return rows.agg(F.count("*").alias("units"), F.countDistinct("unit_key").alias("keys"), F.min("unit_key").alias("least"), F.max("unit_key").alias("most"))


def job_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as units; those by an even supplier have a state, those by one of three a status from before."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("unit"), "l_suppkey").groupBy("job", "unit").agg(F.min("l_suppkey").alias("l_suppkey"))
    units = lines.select("job", "unit")
    prior = lines.where("l_suppkey % 3 = 0").select("job", "unit", F.lit("done").alias("status"))
    states = lines.where("l_suppkey % 2 = 0").select("job", "unit", F.lit("done").alias("state"))
    return jobs.resumed_status(units, prior, states, ["job", "unit"]).groupBy("job", "status").agg(F.count("*").alias("units"))


def done_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old done marks are titles (flag and status of a line); they become keys where a title is one unit's alone."""
    every = table(spark, sf_dir, "lineitem")
    parts = dealt(every.select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("title"), "l_linenumber"), every, "l_orderkey", "title")
    lines = parts.select(F.col("l_orderkey").alias("job"), "title", jobs.unit_key(F.col("l_linenumber"), F.col("title")).alias("unit_key"))
    done = lines.select("job", F.col("title").alias("unit_key")).distinct()
    return jobs.migrated(done, lines, "job")


def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a call with each document as prompt would cost more than a limit by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"), F.lit("none").alias("provider"), F.lit("m").alias("model"), ((F.col("doc_id") % 5) * 0.01).alias("limit"))
    return jobs.with_prices(docs, []).select("doc_id", jobs.over_budget(F.col("tokens"), F.col("limit")).alias("over"))


def job_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the extraction of every document would cost by source, in money: all units, at the fallback price."""
    docs = table(spark, sf_dir, "documents").select("source", X.estimate_tokens(F.col("text")).alias("prompt_tokens"), F.lit("none").alias("provider"), F.lit("m").alias("model"))
    priced = jobs.with_prices(docs, [])
    return jobs.estimated_cost(priced.withColumn("completion_tokens", F.lit(jobs.CALL_TOKENS)), ["source"])


def provider_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    body = F.when(F.col("event_type") == "click", "Quota exceeded").when(F.col("event_type") == "view", "Access denied").otherwise("slow")
    kind = jobs.error_class((F.lit(399) + F.col("event_id") % 40).cast("int"), body)
    return events.select((F.lit(399) + F.col("event_id") % 40).cast("int").alias("status"), kind.alias("kind")).groupBy("status", "kind").agg(F.count("*").alias("events"))


def job_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: customers are projects, suppliers files of the project of their number."""
    requests = _jobs(spark, sf_dir).select("job_id", "project_id", (F.col("job_id") % 97).alias("file_id"), "type", (F.col("job_id") % 4 > 0).alias("has_provider"))
    gone = lambda key, n: F.when(F.col(key) % n == 0, F.lit(NOW).cast("timestamp_ntz")).alias("deleted_at")
    projects = table(spark, sf_dir, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("project_id"), _pick(("recite", "graph", "other"), F.col("c_custkey")).alias("type"), gone("c_custkey", 7))
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.col("s_suppkey").alias("project_id"), gone("s_suppkey", 5))
    near = requests.withColumn("file_id", F.when(F.col("job_id") % 2 == 0, F.col("project_id")).otherwise(F.col("file_id")))
    return jobs.admitted(near, projects, files).select("job_id", "refusal")


def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's failed jobs, newest first; a list is at most 200 rows by design."""
    return study.job_list(_jobs(spark, sf_dir), "failed", None, 200, "updated_at", ["job_id"]).select("job_id", "project_id", "updated_at")


def latest_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's latest successful extraction."""
    return study.latest_success(_jobs(spark, sf_dir), "graph_extract", ["project_id"], ["updated_at", "job_id"], ["job_id"])


def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("type"), F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, c_custkey)").alias("created_at"), F.when(F.col("c_custkey") % 4 == 0, F.lit(NOW).cast("timestamp_ntz")).alias("deleted_at"))
    return study.projects(rows, kind="BUILDING").select("project_id")


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files of each project with their place by upload time."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 6 == 0, F.lit(NOW).cast("timestamp_ntz")).alias("deleted_at"))
    return D.live_files(rows, "project_id", ["created_at", "file_id"]).select("project_id", "file_id", "place")


def find_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pieces titled by priority: the earliest of each customer, status and title."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("piece_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("file_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"))
    return persistence.earliest_piece(rows, ["project_id", "file_id", "title"], ["created_at", "piece_id"], "piece_id")


def next_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("sort_order"))
    return persistence.next_sort_order(rows, "project_id")


def replaced_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of two of three orders are stored; lines of an even supplier are staged. What is stored afterwards."""
    rows = pieces.pairs(spark, sf_dir).select("piece_id", "pair_key", "zh")
    existing = rows.where("piece_id % 3 <> 0")
    staged = rows.where("piece_id % 2 = 0").withColumn("zh", F.lower("zh"))
    decided = persistence.outcomes(staged.groupBy("piece_id").agg((F.count("*") > 2).alias("ok")), existing.groupBy("piece_id").agg((F.first("piece_id") % 5 == 0).cast("int").alias("manual_edits")), ["piece_id"])
    return persistence.replaced(existing, staged, decided, ["piece_id"]).groupBy("piece_id").agg(F.count("*").alias("pairs"), F.min("zh").alias("least"))


def piece_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reports on their orders, several at the same time."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("piece_id"), F.lit(0).alias("last_pos"), F.lit(False).alias("recited"), F.expr("o_orderdate + interval 60 days").alias("updated_at"))
    reports = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("piece_id"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("client_ts"), F.col("l_linenumber").alias("last_pos"), (F.col("l_suppkey") % 2 == 0).alias("recited"))
    return persistence.progress(orders, reports, "piece_id").select("piece_id", "last_pos", "recited")


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as puts of settings by type; the secret one is refused."""
    name = F.when(F.col("event_type") == "error", snapshots.SECRET_SETTINGS[0]).otherwise(F.col("event_type"))
    puts = table(spark, sf_dir, "events").select(F.col("user_id"), name.alias("k"), "ts", "event_id", "value")
    return persistence.settings(puts, ["user_id"], ["ts", "event_id"], ["value"])


def project_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer is to be deleted, none with an active job; every sixth comes back."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    gone = persistence.delete_projects(rows, rows.where("project_id % 3 = 0"), _jobs(spark, sf_dir), NOW)
    return persistence.restore_projects(gone, rows.where("project_id % 6 = 0")).select("project_id", F.col("deleted_at").isNotNull().alias("deleted"))


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A goal for each customer: the stored one, or one of defaults."""
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    stored = wanted.where("project_id % 2 = 0").withColumns({"exam_date": F.lit("2024-06-01").cast("date"), "note": F.when(F.col("project_id") % 4 == 0, "own")})
    return persistence.get_or_create(wanted, stored, ["project_id"], {"exam_date": F.lit("2024-12-31").cast("date"), "note": F.lit("")})


def snapshot_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client starts from: live projects and files, all pieces; rows and keys of each section."""
    cut = lambda t, key, kind: table(spark, sf_dir, t).select(F.col(key).alias("id"), F.when(F.col(key) % kind == 0, F.lit(NOW)).alias("deleted_at"))
    rows = snapshots.bootstrap({"projects": (cut("customer", "c_custkey", 4), ["id"]), "files": (cut("part", "p_partkey", 5), ["id"]), "pieces": (cut("orders", "o_orderkey", 6), ["id"])})
    return rows.groupBy("section").agg(F.count("*").alias("rows"), F.countDistinct("key").alias("keys"), F.sum(F.instr("row", "deleted_at").cast("boolean").cast("int")).alias("with_mark"))


def recycle_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as times of binned files: what a purge takes, with its bytes."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("modificationTime"), F.col("o_orderkey").alias("length"))
    old = D.expired(files, "1998-01-01 00:00:00", 30)
    return D.usage_bytes(old).withColumn("of", F.lit("purged")).unionByName(D.usage_bytes(files).withColumn("of", F.lit("all")))


def write_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes of fields to entities, with and without a zone in their time texts."""
    events = table(spark, sf_dir, "events")
    names = tuple(S.WRITABLE)
    entity = F.when(F.col("event_id") % 9 == 8, "account").otherwise(_pick(names, F.col("event_id")))
    fields = F.array(_pick(("last_pos", "zh", "title", "mastery", "id"), F.col("event_id")))
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(shown, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(shown, F.lit("+02:00"))).otherwise(shown)
    return events.select("event_id", F.coalesce(sync.admission(entity, fields), F.lit("fine")).alias("admission"), F.date_format(sync.utc(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


def category_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines move parts to brands; a brand is the category of the project of its last digit."""
    ops = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("op"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("entity_id"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 50).cast("string")).alias("category_id"))
    part = table(spark, sf_dir, "part")
    digit = F.substring("p_brand", -1, 1)
    nodes = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("node_id"), digit.alias("project_id"))
    categories = part.select(F.col("p_brand").alias("category_id"), digit.alias("project_id")).distinct()
    return sync.foreign_category(ops, nodes, categories).groupBy(F.coalesce("refused", F.lit("fine")).alias("outcome")).agg(F.count("*").alias("ops"))


def queue_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays queued where errors stay and every fifth user's sending broke off at the second batch."""
    queue = sync.pages(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("op_id"), F.col("ts").alias("client_ts"), "event_type"), ["key"], ["op_id"], 20)
    results = queue.select("op_id", F.when(F.col("event_type") == "error", "error").otherwise("applied").alias("status"))
    return sync.remaining(queue, results, failed_from=F.when(F.col("key") % 5 == 0, 1)).select("key", "op_id", "batch")


def reveal_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    at = study.position_after_reveal((F.col("l_partkey") % 9).cast("int"), F.col("l_linenumber"))
    place = study.clamp_position(F.when(F.col("l_suppkey") % 4 > 0, F.col("l_quantity") - 10.5), F.col("l_linenumber"))
    return lines.select("l_orderkey", "l_linenumber", at.alias("after"), place.alias("place"))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a draft's preview: parts by what is to become of them."""
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("project"), "p_partkey", "p_brand")
    state = F.when(F.col("p_partkey") % 10 == 0, "deleted").when(F.col("p_partkey") % 10 == 1, "moved").otherwise(F.col("p_brand"))
    return graph.preview_groups(part, ["project"], ["p_partkey"], state)


def graph_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables that replace the graphs of the drafts, with distinct ids and texts. Ids are compared as their 16 bytes."""
    nodes, categories = work.stored_draft(spark, sf_dir)
    full = nodes.withColumns({"quote": F.when(F.col("name").cast("long") % 3 > 0, F.col("name")).otherwise(""), "summary": F.lit("s"), "weight": F.lit(2), "loc_page": (F.col("name").cast("long") % 4).cast("int")})
    out = graph.stored(full, categories, work.edges_of(nodes, nodes), ["project"])
    count = lambda name, key, extra: out[name].agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.countDistinct(*(F.unhex(k) for k in key)).alias("keys"), F.coalesce(extra, F.lit(0)).cast("long").alias("extra"))
    rows = [count("categories", ["category_id"], F.max("sort_order")), count("nodes", ["node_id"], F.sum("weight")), count("card_quotes", ["node_id"], F.sum("page")), count("edges", ["from_node", "to_node"], F.count("reason"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def graph_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes with their last quote, whether they have one or not."""
    from . import study as plans

    return study.graph_pull(plans.nodes(spark, sf_dir), plans.quotes(spark, sf_dir)).select("node_id", "category_id", "quote_text", "page")


def mastered_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of one level of mastery."""
    from . import study as plans

    return study.flashcards(plans.nodes(spark, sf_dir), plans.quotes(spark, sf_dir), mastery="mid").select("node_id", "question", "answer")


def upload_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as uploads in chunks of 64 bytes; every fifth lacks its second chunk, every seventh has another sum."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("session_id"), F.encode("text", "UTF-8").alias("body"))
    total = F.ceil(F.length("body") / 64).cast("int")
    chunks = items.select("session_id", "body", F.explode(F.sequence(F.lit(0), total - 1)).alias("index")).select("session_id", "index", F.expr("substring(body, index * 64 + 1, 64)").alias("data"))
    sessions = items.select("session_id", F.length("body").alias("size"), F.when(F.col("session_id") % 7 == 0, F.lit("x")).otherwise(F.sha2("body", 256)).alias("sha256"))
    received = chunks.where(~((F.col("session_id") % 5 == 0) & (F.col("index") == 1)))
    done = D.completed(sessions, received, 64)
    return done.select("session_id", "total", F.size("missing").alias("missing"), F.coalesce("refusal", F.lit("none")).alias("refusal"))


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of orders as a list shows them, and halves of Chinese texts."""
    orders = table(spark, sf_dir, "orders")
    now = F.lit("1998-08-02 00:00:00").cast("timestamp_ntz")
    zh = F.concat(F.lit("甲"), F.repeat(F.lit("乙"), (F.col("o_orderkey") % 7).cast("int")), F.lit("。"), F.repeat(F.lit("丙"), (F.col("o_orderkey") % 5).cast("int")))
    half = X.split_zh_half(zh)
    return orders.select("o_orderkey", X.relative_time(F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate")), now).alias("ago"), half["a"].alias("a"), half["b"].alias("b"), X.format_countdown((F.col("o_orderkey") % 4000).cast("int")).alias("left"), X.parse_clock(F.concat((F.col("o_orderkey") % 70).cast("string"), F.lit(":"), (F.col("o_orderkey") % 75).cast("string"))).alias("timer"))


_JOBS = f"""jobs AS (SELECT o_orderkey AS job_id, o_custkey AS project_id, [{", ".join(f"'{x}'" for x in _STATUSES)}][o_orderkey % 6 + 1] AS status, [{", ".join(f"'{x}'" for x in _KINDS)}][o_custkey % 3 + 1] AS type,
  o_orderdate AS updated_at, o_orderkey % 11 AS done, o_orderkey % 3 AS failed, o_orderkey % 17 AS total FROM orders)"""
_TOKENS = f"CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '[^{S.CJK_LETTERS}]', '', 'g')) + (length(text) - length(regexp_replace(text, '[^{S.CJK_LETTERS}]', '', 'g'))) // 4 + 1 END"
_WRITABLE = " ".join(f"WHEN '{e}' THEN field IN ({', '.join(repr(f) for f in fields)})" for e, fields in S.WRITABLE.items())
_NAMES = ", ".join(f"'{e}'" for e in S.WRITABLE)
ORACLES = {
    "job_moves": f"""WITH {_JOBS} SELECT job_id, CASE WHEN status IN ('queued', 'running', 'interrupted') THEN 'cancelled' END AS cancel, CASE WHEN status IN ('failed', 'cancelled', 'interrupted') THEN 'queued' END AS resume,
  CASE WHEN status = 'success' THEN 100 ELSE ((done + failed) * 100 // greatest(total, 1))::INT END AS percent, CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS restarted FROM jobs""",
    "unit_keys": "WITH k AS (SELECT printf('%04d', event_id) || ':t' AS k FROM events) SELECT count(*) AS units, count(DISTINCT k) AS keys, min(k) AS least, max(k) AS most FROM k",
    "job_resume": """WITH l AS (SELECT l_orderkey AS job, l_linenumber AS unit, min(l_suppkey) AS s FROM lineitem GROUP BY ALL) SELECT job, CASE WHEN s % 3 = 0 AND s % 2 = 0 THEN 'done' ELSE 'pending' END AS status, count(*) AS units FROM l GROUP BY ALL""",
    "done_marks": """WITH l AS (SELECT l_orderkey AS job, l_returnflag || l_linestatus AS title, l_linenumber AS n FROM lineitem) SELECT job, CASE WHEN count(*) = 1 THEN printf('%04d', min(n)) || ':' || title ELSE title END AS unit_key FROM l GROUP BY job, title""",
    "call_budget": f"SELECT doc_id, coalesce(lim > 0 AND t / 1000000 * 5.0::DOUBLE + 1000 / 1000000 * 20.0::DOUBLE > lim, false) AS over FROM (SELECT doc_id, (doc_id % 5) * 0.01::DOUBLE AS lim, {_TOKENS} AS t FROM documents)",
    "job_estimate": f"SELECT source, count(*) AS units, sum({_TOKENS})::BIGINT AS prompt_tokens, round(sum({_TOKENS}) * 5.0 / 1000000 + count(*) * 1000 * 20.0 / 1000000, 6)::DOUBLE AS cost FROM documents GROUP BY source",
    "provider_errors": """WITH e AS (SELECT (399 + event_id % 40)::INT AS status, event_type AS t FROM events) SELECT status, CASE WHEN status IN (401, 403) THEN CASE WHEN t = 'view' THEN 'bad_request' ELSE 'key_invalid' END WHEN status = 429 THEN CASE WHEN t = 'click' THEN 'quota_exceeded' ELSE 'rate_limited' END
  WHEN status = 402 THEN 'quota_exceeded' WHEN status IN (400, 404, 413, 422) THEN 'bad_request' ELSE 'provider_error' END AS kind, count(*) AS events FROM e GROUP BY ALL""",
    "job_admission": f"""WITH {_JOBS}, r AS (SELECT job_id, project_id, CASE WHEN job_id % 2 = 0 THEN project_id ELSE job_id % 97 END AS file_id, type, job_id % 4 > 0 AS has FROM jobs),
p AS (SELECT c_custkey AS project_id, ['recite_align', 'graph_extract', ''][c_custkey % 3 + 1] AS want, c_custkey % 7 = 0 AS gone FROM customer WHERE c_custkey % 13 <> 0)
SELECT job_id, CASE WHEN type = 'export' THEN 'type' WHEN want IS NULL OR gone THEN 'no project' WHEN want <> type THEN 'kind' WHEN s_suppkey IS NULL OR s_suppkey % 5 = 0 THEN 'no file' WHEN s_suppkey <> r.project_id THEN 'other project'
  WHEN type = 'graph_extract' AND NOT has THEN 'no provider' END AS refusal FROM r LEFT JOIN p ON p.project_id = r.project_id LEFT JOIN supplier ON s_suppkey = file_id""",
    "job_list": f"WITH {_JOBS} SELECT job_id, project_id, updated_at FROM jobs WHERE status = 'failed' ORDER BY updated_at DESC, job_id LIMIT 200",
    "latest_extraction": f"WITH {_JOBS} SELECT project_id, arg_max(job_id, (updated_at, job_id)) AS job_id FROM jobs WHERE status = 'success' AND type = 'graph_extract' GROUP BY project_id",
    "project_list": "SELECT c_custkey AS project_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 4 <> 0",
    "file_list": "SELECT o_custkey AS project_id, o_orderkey AS file_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS place FROM orders WHERE o_orderkey % 6 <> 0",
    "find_piece": "SELECT o_custkey AS project_id, o_orderstatus AS file_id, o_orderpriority AS title, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS piece_id FROM orders GROUP BY ALL",
    "next_orders": "SELECT o_custkey AS project_id, coalesce(max(o_orderkey) FILTER (WHERE o_orderkey % 3 > 0), -1) + 1 AS next_sort_order FROM orders GROUP BY o_custkey",
    "replaced_pieces": """WITH l AS (SELECT l_orderkey AS piece_id, l_returnflag || l_partkey AS zh FROM lineitem), p AS (SELECT piece_id, count(*) AS n, min(zh) AS z, min(lower(zh)) AS low FROM l GROUP BY piece_id),
d AS (SELECT *, piece_id % 2 = 0 AND n > 2 AND (piece_id % 3 = 0 OR piece_id % 5 <> 0) AS taken FROM p) SELECT piece_id, n AS pairs, CASE WHEN taken THEN low ELSE z END AS least FROM d WHERE taken OR piece_id % 3 <> 0""",
    "piece_progress": """WITH r AS (SELECT l_orderkey AS piece_id, max((date_trunc('month', l_shipdate)::TIMESTAMP, l_linenumber, l_suppkey % 2 = 0)) AS m FROM lineitem GROUP BY 1)
SELECT o_orderkey AS piece_id, CASE WHEN coalesce(m[1] >= o_orderdate + INTERVAL 60 DAY, false) THEN m[2] ELSE 0 END AS last_pos, CASE WHEN coalesce(m[1] >= o_orderdate + INTERVAL 60 DAY, false) THEN m[3] ELSE false END AS recited FROM orders LEFT JOIN r ON piece_id = o_orderkey""",
    "settings": "SELECT user_id, event_type AS k, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type <> 'error' GROUP BY ALL",
    "project_bin": f"WITH {_JOBS} SELECT c_custkey AS project_id, c_custkey % 3 = 0 AND c_custkey % 6 <> 0 AND NOT EXISTS (SELECT 1 FROM jobs WHERE project_id = c_custkey AND status IN ('queued', 'running')) AS deleted FROM customer",
    "goals": "SELECT c_custkey AS project_id, CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-06-01' ELSE DATE '2024-12-31' END AS exam_date, CASE WHEN c_custkey % 4 = 0 THEN 'own' ELSE '' END AS note FROM customer",
    "snapshot_start": "SELECT 'projects' AS section, count(*) AS rows, count(*) AS keys, 0::BIGINT AS with_mark FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT 'files', count(*), count(*), 0 FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'pieces', count(*), count(*), count(*) FROM orders",
    "recycle_bin": "SELECT 'all' AS of, sum(o_orderkey)::BIGINT AS bytes FROM orders UNION ALL SELECT 'purged', coalesce(sum(o_orderkey), 0)::BIGINT FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY",
    "write_admission": f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 8 THEN 'account' ELSE [{_NAMES}][event_id % {len(S.WRITABLE)} + 1] END AS entity, ['last_pos', 'zh', 'title', 'mastery', 'id'][event_id % 5 + 1] AS field, date_trunc('second', ts) AS ts FROM events)
SELECT event_id, CASE WHEN coalesce(CASE entity {_WRITABLE} END, false) THEN 'fine' ELSE 'error' END AS admission, strftime(CASE WHEN event_id % 3 = 1 THEN ts - INTERVAL 2 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') AS at FROM e""",
    "category_moves": """WITH c AS (SELECT DISTINCT p_brand AS b FROM part), o AS (SELECT l_partkey AS e, 'Brand#' || (l_suppkey % 50) AS b FROM lineitem)
SELECT CASE WHEN p_partkey IS NOT NULL AND (c.b IS NULL OR right(c.b, 1) <> right(p_brand, 1)) THEN 'error' ELSE 'fine' END AS outcome, count(*) AS ops FROM o LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) ON p_partkey = e LEFT JOIN c ON c.b = o.b GROUP BY ALL""",
    "queue_left": "WITH q AS (SELECT user_id AS key, event_id AS op_id, event_type, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20)::INT AS batch FROM events) SELECT key, op_id, batch FROM q WHERE event_type = 'error' OR (key % 5 = 0 AND batch >= 1)",
    "reveal_positions": "SELECT l_orderkey, l_linenumber, greatest((l_partkey % 9)::INT, l_linenumber + 1)::INT AS after, coalesce(CASE WHEN l_suppkey % 4 > 0 THEN least(greatest(floor(l_quantity - 10.5 + 0.5), 0), l_linenumber) END, 0)::BIGINT AS place FROM lineitem",
    "preview": """WITH s AS (SELECT p_size AS project, p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'deleted' WHEN p_partkey % 10 = 1 THEN 'moved' ELSE p_brand END AS state FROM part)
SELECT project, state, count(*) AS nodes, (row_number() OVER (PARTITION BY project ORDER BY min(p_partkey)) - 1)::INT AS place FROM s GROUP BY project, state""",
    "graph_stored": f"""WITH {work.DRAFT}, e AS (SELECT DISTINCT project, unit, least(node, other), greatest(node, other) FROM links)
SELECT 'categories' AS "table", count(*) AS rows, count(*) AS keys, max(sort_order)::BIGINT AS extra FROM cats UNION ALL SELECT 'nodes', count(*), count(*), 2 * count(*) FROM nodes
UNION ALL SELECT 'card_quotes', count(*), count(*), coalesce(sum(part % 4), 0)::BIGINT FROM nodes WHERE part % 3 > 0 UNION ALL SELECT 'edges', count(*), count(*), count(*) FROM e""",
    "upload_sessions": """SELECT item_id AS session_id, ceil(n / 64)::INT AS total, CASE WHEN item_id % 5 = 0 AND n > 64 THEN 1 ELSE 0 END AS missing, CASE WHEN item_id % 5 = 0 AND n > 64 THEN 'chunks' WHEN item_id % 7 = 0 THEN 'checksum' ELSE 'none' END AS refusal FROM (SELECT item_id, strlen(text) AS n FROM benchmark)""",
    "clocks": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS d, datediff('second', o_orderdate, TIMESTAMP '1998-08-02') AS s, (o_orderkey % 7)::INT AS m, (o_orderkey % 5)::INT AS n FROM orders),
h AS (SELECT *, 2 + m + n AS size, (2 + m + n) // 2 AS mid, m + 2 AS e FROM o)
SELECT k AS o_orderkey, CASE WHEN d IS NULL THEN '还没开始' WHEN s < 60 THEN '刚刚' WHEN s < 3600 THEN (s // 60) || ' 分钟前' WHEN s < 86400 THEN (s // 3600) || ' 小时前' WHEN s < 2592000 THEN (s // 86400) || ' 天前' ELSE strftime(d, '%Y-%m-%d') END AS ago,
  ('甲' || repeat('乙', m) || '。' || repeat('丙', n))[1:CASE WHEN e >= size THEN mid ELSE e END] AS a, ('甲' || repeat('乙', m) || '。' || repeat('丙', n))[CASE WHEN e >= size THEN mid ELSE e END + 1:] AS b,
  (k % 4000 // 60) || ':' || printf('%02d', k % 4000 % 60) AS "left", CASE WHEN k % 75 <= 59 THEN least(3600, greatest(10, k % 70 * 60 + k % 75))::INT END AS timer FROM h""",
}
QUERIES = {
    f.__name__: f
    for f in (
        job_moves, unit_keys, job_resume, done_marks, call_budget, job_estimate, provider_errors, job_admission, job_list, latest_extraction, project_list, file_list, find_piece, next_orders, replaced_pieces, piece_progress, settings,
        project_bin, goals, snapshot_start, recycle_bin, write_admission, category_moves, queue_left, reveal_positions, preview, graph_stored, graph_pull, mastered_cards, upload_sessions, clocks,
    )
}
