"""Queries that write: rules of many projects, saved pieces and graphs, snapshots, files. Each writes to a folder of its own and
reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, jobs, rules
from ..session import stored, table
from ..sources import documents as D
from ..sources import projects, snapshots
from ..streaming.replay import shared_folder
from . import pieces, work


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each nation, in seven projects' lists; the fifth project's has one that is no regular expression."""
    k = F.col("n_nationkey")
    kind = F.element_at(F.array(*map(F.lit, ("regex", "contains", "prefix"))), (k % 3 + 1).cast("int"))
    pattern = (
        F.when(k == 12, "((").when(kind == "regex", F.concat(F.lit("/(de|fr)/[0-9]*"), (k % 10).cast("string"), F.lit("($|[#?])")))
        .when(kind == "contains", F.concat(F.lit(" example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), (k % 4 % 3 + 1).cast("int")))).otherwise(F.when(k % 2 == 0, "https://m.").otherwise("http://t"))
    )
    return table(spark, sf_dir, "nation").select(
        (k % 7).cast("long").alias("project_id"), (100 - k).cast("long").alias("place"), F.when(k % 2 == 0, "unit_title").otherwise("file_name").alias("match_on"), kind.alias("kind"), pattern.alias("pattern"),
        F.concat(F.lit(" "), "n_name").alias("category"), (k % 6 != 5).alias("enabled"),
    )


def _ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Eight projects have an old rule."""
    old = table(spark, sf_dir, "nation").where("n_nationkey < 8").select(
        F.concat(F.lit("old"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").cast("long").alias("project_id"), F.lit("file_name").alias("match_on"), F.lit("prefix").alias("kind"), F.lit("http").alias("pattern"), F.lit("old").alias("category"), F.lit(True).alias("enabled"), F.lit(0).alias("priority"),
    )
    return rules.put_rules(old, _puts(spark, sf_dir))


def rules_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of all projects after their lists were saved."""
    return _ruled(spark, sf_dir)[0].select("project_id", "priority", "match_on", "kind", "pattern", "category", "enabled")


def rules_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir)[1]


def rules_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as units of nine projects; every eleventh has no file name."""
    units = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 9).alias("project_id"), F.when(F.col("page_id") % 11 != 0, F.col("url")).alias("file_name"), F.substring(F.col("url"), 2, 1000).alias("unit_title"))
    return rules.classify(units, _ruled(spark, sf_dir)[0], ["page_id"]).select("page_id", "rule_category")


def saved_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the orders are stored, some with hand edits; all are saved anew, twice over."""
    path = _folder(spark, "pieces")
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("piece_id"), F.col("o_custkey").alias("project_id"))
    # Written once, as five plans read it.
    rows = stored(pieces.pairs(spark, sf_dir).select("piece_id", "seq", "zh", "en", "confidence", "manually_edited").join(owner, "piece_id"), "pairs", "zstd")
    rows = rows.select("project_id", "piece_id", "seq", "zh", "en", "confidence", "manually_edited")
    first = rows.where("piece_id % 3 <> 0")
    projects.replace(path, first, first.select("project_id").distinct())
    staged = rows.groupBy("project_id", "piece_id").agg((F.min("confidence") >= 0.92).alias("ok"))
    fresh = rows.withColumns({"zh": F.concat("zh", F.lit("!")), "manually_edited": F.lit(False)})
    for _ in range(2):
        projects.save_pieces(path, staged, fresh, ["piece_id"])
    return projects.read(spark, path).select("project_id", "piece_id", "seq", "zh", "manually_edited")


def _saved_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All graphs are saved, then the edited ones of every third project; every fifth of these has no file."""
    path, keys = _folder(spark, "graphs"), ["project"]
    more = lambda df: df.withColumns({"quote": F.concat(F.lit("q"), "name"), "loc_page": F.pmod(F.col("weight"), F.lit(4))})
    nodes, categories = work.stored_draft(spark, sf_dir)
    # Only every third project is saved again, so no other's edits are made.
    third = "project % 3 = 0"
    kept = stored(work.edited(nodes.where(third), categories.where(third)), "edited-nodes")
    left = graph.prune(categories.where(third), kept, keys)
    nodes, kept = (df.withColumn("weight", F.col("node") + 1) for df in (nodes, kept))
    drafts = categories.select("project").distinct()
    file = F.when(F.col("project") % 5 != 0, "f")
    projects.save_graph(path, graph.stored(more(nodes), categories, work.edges_of(nodes, nodes), keys), drafts.withColumn("file_id", F.lit("f")), "project")
    projects.save_graph(path, graph.stored(more(kept), left, work.edges_of(kept, kept), keys), drafts.where(third).withColumn("file_id", file), "project")
    return {name: projects.read(spark, f"{path}/{name}") for name in ("categories", "nodes", "card_quotes", "edges")}


def saved_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored nodes."""
    return _saved_graph(spark, sf_dir)["nodes"].select("project", "node_id", "category_id", "name", "weight")


def saved_graph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each stored table by project."""
    counts = [rows.groupBy("project").agg(F.count("*").alias("rows")).withColumn("table", F.lit(name)) for name, rows in _saved_graph(spark, sf_dir).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_SECTIONS = {"customer": "c_custkey", "nation": "n_nationkey", "orders": "o_orderkey", "part": "p_partkey", "region": "r_regionkey", "supplier": "s_suppkey"}


def _snapshot(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "snapshot")
    snapshots.write(snapshots.exported({n: (table(spark, sf_dir, n), [k]) for n, k in _SECTIONS.items()}), path)
    return path


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export as files, read back."""
    return snapshots.read_rows(spark, _snapshot(spark, sf_dir)).select("section", "row")


def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of each section; ranges of files that overlap, and files that aren't as it says."""
    path = _snapshot(spark, sf_dir)
    listed = snapshots.read_manifest(spark, path).withColumns({e: F.regexp_extract(e, "[0-9]+", 0).cast("long") for e in ("first", "last")})
    by = Window.partitionBy("section").orderBy("first")
    overlaps = listed.withColumn("over", F.coalesce(F.lag("last").over(by) >= F.col("first"), F.lit(False)))
    whole = overlaps.groupBy("section").agg(F.sum("rows").cast("long").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"), F.count_if("over").alias("overlaps"))
    broken = snapshots.damage(spark, path).groupBy("section").agg(F.count("*").alias("damaged"))
    return whole.join(broken, "section", "left").withColumn("damaged", F.coalesce("damaged", F.lit(0).cast("long")))


def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the files of documents by language, from what the file system says of them."""
    path = _folder(spark, "texts")
    table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    return D.listed(spark, path).groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(F.sum("length").alias("bytes"))


def old_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of orders' lines at a resume: every second has no key yet, every third line is done."""
    unit = jobs.unit_key(F.col("l_linenumber"), F.concat("l_returnflag", "l_linestatus"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.concat("l_returnflag", "l_linestatus").alias("title"), unit.alias("unit_key"), F.col("l_linenumber").cast("long").alias("n"))
    done = lines.where("n % 3 = 0").select("job", "unit_key")
    failures = lines.select("job", "title", F.when(F.col("n") % 2 == 0, F.col("unit_key")).alias("unit_key"), F.col("n").alias("place"))
    again = failures.where("place % 4 = 0").withColumn("place", F.col("place") + 100)
    return jobs.migrated_failures(failures.unionByName(again), done, lines, "job")


_PUTS = """puts AS (SELECT n_nationkey AS k, n_nationkey % 7 AS project_id, 100 - n_nationkey AS place, CASE WHEN n_nationkey % 2 = 0 THEN 'unit_title' ELSE 'file_name' END AS match_on, ['regex', 'contains', 'prefix'][n_nationkey % 3 + 1] AS kind,
  CASE WHEN n_nationkey = 12 THEN '((' WHEN n_nationkey % 3 = 0 THEN '/(de|fr)/[0-9]*' || n_nationkey % 10 || '($|[#?])' WHEN n_nationkey % 3 = 1 THEN 'example.' || ['com', 'net', 'org'][n_nationkey % 4 % 3 + 1] WHEN n_nationkey % 2 = 0 THEN 'https://m.' ELSE 'http://t' END AS pattern,
  n_name AS category, n_nationkey % 6 <> 5 AS enabled FROM nation),
ruled AS (
  SELECT project_id, (row_number() OVER (PARTITION BY project_id ORDER BY place) - 1)::INT AS priority, match_on, kind, pattern, category, enabled FROM puts WHERE project_id <> 5
  UNION ALL SELECT n_nationkey, 0, 'file_name', 'prefix', 'http', 'old', true FROM nation WHERE n_nationkey IN (5, 7)
)"""
_TAKEN = "project % 3 = 0 AND project % 5 <> 0 AND project IN (FROM alive)"

_JSON = {"orders": "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') AS o_orderdate) FROM orders"}
ORACLES = {
    "snapshot_rows": " UNION ALL ".join(f"SELECT '{n}' AS section, to_json(t)::VARCHAR AS row FROM ({_JSON.get(n, f'FROM {n}')}) t" for n in _SECTIONS),
    "snapshot_manifest": " UNION ALL ".join(f"SELECT '{n}' AS section, count(*) AS rows, min({k})::BIGINT AS first, max({k})::BIGINT AS last, 0::BIGINT AS overlaps, 0::BIGINT AS damaged FROM {n}" for n, k in _SECTIONS.items()),
    "storage_usage": "SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY 1",
    "old_failures": """WITH l AS (SELECT l_orderkey AS job, l_returnflag || l_linestatus AS title, printf('%04d', l_linenumber) || ':' || l_returnflag || l_linestatus AS k, l_linenumber AS n FROM lineitem),
u AS (SELECT job, title, count(*) AS c, min(k) AS k FROM l GROUP BY ALL), f AS (SELECT job, title, CASE WHEN n % 2 = 0 THEN k END AS k, n::BIGINT AS place FROM l UNION ALL SELECT job, title, k, n + 100 FROM l WHERE n % 4 = 0),
named AS (SELECT f.job, f.title, coalesce(f.k, CASE WHEN c = 1 THEN u.k END) AS unit_key, place FROM f JOIN u ON u.job = f.job AND u.title = f.title)
SELECT job, title, unit_key, max(place) AS place FROM named WHERE unit_key IS NOT NULL AND (job, unit_key) NOT IN (SELECT (job, k) FROM l WHERE n % 3 = 0) GROUP BY job, title, unit_key""",
    "rules_put": f"WITH {_PUTS} SELECT * FROM ruled",
    "rules_refused": "SELECT 5::BIGINT AS project_id, 88::BIGINT AS place, 'regex' AS refused",
    "rules_classify": f"""WITH {_PUTS}, units AS (SELECT page_id, page_id % 9 AS project_id, CASE WHEN page_id % 11 <> 0 THEN url ELSE '' END AS file_name, url[2:] AS unit_title FROM pages),
texts AS (SELECT page_id, u.project_id, priority, kind, pattern, category, CASE WHEN match_on = 'unit_title' THEN unit_title ELSE file_name END AS t FROM units u JOIN ruled r ON u.project_id = r.project_id AND enabled),
hits AS (SELECT * FROM texts WHERE CASE kind WHEN 'prefix' THEN starts_with(t, pattern) WHEN 'contains' THEN contains(t, pattern) ELSE regexp_matches(t, pattern) END)
SELECT page_id, arg_min(category, priority) AS rule_category FROM units LEFT JOIN hits USING (page_id) GROUP BY page_id""",
    "saved_pieces": f"""WITH {pieces._PAIRS}, x AS (SELECT piece_id, min(confidence) >= 0.92 AS ok, count(*) FILTER (WHERE manually_edited) AS edits FROM pairs GROUP BY piece_id),
y AS (SELECT piece_id, ok AND (piece_id % 3 = 0 OR edits = 0) AS taken FROM x)
SELECT o_custkey AS project_id, piece_id, seq, CASE WHEN taken THEN zh || '!' ELSE zh END AS zh, NOT taken AND manually_edited AS manually_edited FROM pairs JOIN y USING (piece_id) JOIN orders ON o_orderkey = piece_id WHERE taken OR piece_id % 3 <> 0""",
    "saved_graph": f"""WITH before AS ({work.ORACLES["graph_nodes"]}), after AS ({work.ORACLES["graph_edit"]}), alive AS (SELECT DISTINCT project FROM after),
kept AS (SELECT project, node_key, category_key, name FROM before WHERE NOT ({_TAKEN}) UNION ALL SELECT project, node_key, category_key, name FROM after WHERE {_TAKEN})
SELECT project, md5(project || '|' || node_key) AS node_id, md5(project || '|' || category_key) AS category_id, name, (regexp_extract(node_key, 'n([0-9]+)$', 1)::INT + 1)::INT AS weight FROM kept""",
    "saved_graph_rows": f"""WITH before AS ({work.ORACLES["graph_nodes"]}), after AS ({work.ORACLES["graph_edit"]}), alive AS (SELECT DISTINCT project FROM after),
kept AS (SELECT project, name FROM before WHERE NOT ({_TAKEN}) UNION ALL SELECT project, name FROM after WHERE {_TAKEN}),
totals AS ({work.ORACLES["graph_edit_totals"]}), old AS (SELECT project, count(*) AS edges FROM ({work.ORACLES["graph_edges"]}) GROUP BY project), cats AS (SELECT project, count(DISTINCT category_key) AS n FROM before GROUP BY project)
SELECT project, count(*) AS rows, 'nodes' AS "table" FROM kept GROUP BY project UNION ALL SELECT project, count(*), 'card_quotes' FROM kept GROUP BY project
UNION ALL SELECT project, n, 'categories' FROM cats WHERE NOT ({_TAKEN}) UNION ALL SELECT project, categories, 'categories' FROM totals WHERE {_TAKEN}
UNION ALL SELECT project, edges, 'edges' FROM old WHERE NOT ({_TAKEN}) UNION ALL SELECT project, edges, 'edges' FROM totals WHERE edges > 0 AND {_TAKEN}""",
}
QUERIES = {f.__name__: f for f in (rules_put, rules_refused, rules_classify, saved_pieces, saved_graph, saved_graph_rows, snapshot_rows, snapshot_manifest, storage_usage, old_failures)}
