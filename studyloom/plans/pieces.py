"""Queries over pieces and pairs: orders are pieces, their lines are pairs; conversations are bilingual turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alignment, persistence, quality, study
from ..session import dealt, table
from . import forms as S
from . import balance_sql as B

_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pairs: ``seq`` from 0 in a total order, a block by return flag, confidence by discount."""
    every = table(spark, sf_dir, "lineitem")
    # The few columns move before texts are made of them.
    lines = dealt(every.select(*_KEY, "l_returnflag", "l_linestatus", "l_discount", "l_tax"), every, "l_orderkey")
    rows = lines.select(
        F.col("l_orderkey").alias("piece_id"), F.concat_ws("-", *(F.col(c).cast("int") if c == "l_quantity" else F.col(c) for c in _KEY)).alias("pair_key"),
        F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("zh"), F.concat_ws(" ", "l_linestatus", F.col("l_suppkey").cast("string")).alias("en"),
        F.when(F.col("l_quantity") % 10 != 0, F.ascii("l_returnflag")).alias("block_no"), (F.col("l_suppkey") % 7).cast("int").alias("loc_page"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        (F.col("l_tax") > 0.06).alias("needs_review"), F.lit("direct").alias("how"), (F.col("l_partkey") % 5 == 0).alias("manually_edited"), "l_linenumber",
    )
    by = Window.partitionBy("piece_id").orderBy("l_linenumber", "pair_key")
    return rows.withColumn("seq", (F.row_number().over(by) - 1).cast("int")).drop("l_linenumber")


def piece_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the number of its lines, zero included."""
    pieces = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("piece_id"), F.col("o_custkey").alias("project_id"))
    return study.piece_counts(pieces, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("piece_id")), "piece_id")


def pair_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.pair_page(pairs(spark, sf_dir), "piece_id", "seq", from_seq=1, limit=3).select("piece_id", "seq", "pair_key")


def pair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    merged = persistence.merge_pairs(rows, rows.where("seq % 3 = 0 and piece_id % 2 = 0").select("pair_key"), "piece_id")
    return merged.select("piece_id", "seq", "zh", "en", "block_no", "needs_review", "how", "manually_edited", F.round("confidence", 4).alias("confidence"))


def pair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    cuts = rows.where("seq % 2 = 1").select("pair_key", F.left("zh", F.lit(1)).alias("zh_a"), F.substring(F.col("zh"), 2, 100).alias("zh_b"), F.left("en", F.lit(1)).alias("en_a"), F.substring(F.col("en"), 2, 100).alias("en_b"))
    return persistence.split_pairs(rows, cuts.dropDuplicates(["pair_key"]), "piece_id").select("piece_id", "seq", "zh", "en", "block_no", "how", "manually_edited")


def block_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = study.units(pairs(spark, sf_dir), "piece_id", ["seq"])
    pieces = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("piece_id"), (F.col("o_orderkey") % 5).cast("int").alias("last_pos"))
    return study.unit_progress(rows, pieces, "piece_id")


def unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.unit_rows(study.units(pairs(spark, sf_dir), "piece_id", ["seq"]), "piece_id", ["seq"])


def upsert_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines are staged again; two of three orders are stored already, some with hand edits."""
    rows = pairs(spark, sf_dir)
    existing = rows.where("piece_id % 3 <> 0").groupBy("piece_id").agg(F.count_if("manually_edited").alias("manual_edits"))
    staged = rows.groupBy("piece_id").agg((F.min("confidence") >= 0.92).alias("ok"))
    return persistence.outcomes(staged, existing, ["piece_id"]).groupBy("outcome").agg(F.count("*").alias("pieces"), F.sum("wiped_edits").alias("wiped_edits"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the answer to it."""
    talk = table(spark, sf_dir, "conversations")
    by = Window.partitionBy("conv_id").orderBy("turn")
    follow = talk.select("conv_id", "turn", "role", F.col("text").alias("zh_text"), F.lead("text").over(by).alias("en_text"), F.lead("role").over(by).alias("next_role"))
    return follow.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "zh_text", "en_text")


def _turn_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", X.segments(F.col("zh_text")).alias("zh"), X.segments(F.col("en_text")).alias("en"))


def align_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned and flagged sentence pairs of every turn and its answer."""
    keys = ["conv_id", "turn"]
    return alignment.flag(alignment.align(_turn_sentences(spark, sf_dir), keys), keys)


def align_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the balanced alignment with pairs of even chunks."""
    keys = ["conv_id", "turn"]
    rows = _turn_sentences(spark, sf_dir).where("size(zh) > 0 and size(en) > 0")
    k = F.least(F.size("zh"), F.size("en"))
    even = rows.select(*keys, "zh", F.explode(alignment.even_chunks(F.size("zh"), k)).alias("c")).select(*keys, F.col("c.chunk").alias("seq"), F.array_join(F.slice("zh", F.col("c.offset") + 1, F.col("c.take")), "").alias("zh"))
    cut = lambda p: alignment.boundaries(p, keys)
    return alignment.agreement(cut(alignment.align(rows, keys)), cut(even), keys).withColumn("confidence", alignment.agreement_confidence(F.col("agreement")))


def align_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turn_sentences(spark, sf_dir)
    n, m = F.size("zh"), F.size("en")
    return rows.select("conv_id", "turn", n.alias("n_zh"), m.alias("n_en"), alignment.chunk_count(n, m, 3).alias("chunks"), alignment.solvable(n, m).alias("solvable"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over conversations as pieces: their turns are the pairs."""
    rows = turns(spark, sf_dir).select("conv_id", F.col("turn").alias("seq"), F.col("zh_text").alias("zh"), F.col("en_text").alias("en"), (F.lit(1.0) - F.col("turn") / 20).alias("confidence"), (F.col("turn") > 4).alias("needs_review"))
    return quality.gate(rows, ["conv_id"]).select("conv_id", "verdict", F.round("score", 6).alias("score"), F.array_join("issues", ",").alias("issues"))


def gate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over conversations, their first side written in Chinese, whose alignments have an agreement, dropped sentences and warnings, and
    over some without pairs."""
    rows = turns(spark, sf_dir).select("conv_id", F.col("turn").alias("seq"), F.regexp_replace("zh_text", "[A-Za-z]", "文").alias("zh"), F.col("en_text").alias("en"), (F.lit(1.0) - F.col("turn") / 20).alias("confidence"), (F.col("turn") > 4).alias("needs_review"))
    c = F.col("conv_id")
    known = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    known = known.unionByName(known.where("conv_id % 7 = 0").select((-c - 1).alias("conv_id")))
    given = known.select("conv_id", F.when(c % 6 != 0, F.pmod(c, F.lit(10)) / 10).alias("agreement"), F.when(c % 9 == 0, 2).otherwise(0).alias("dropped_zh"), F.when(c % 8 == 0, 1).alias("dropped_en"), (c % 5 == 0).cast("int").alias("warnings"))
    return quality.gate(rows, ["conv_id"], given).select("conv_id", "verdict", F.array_join("issues", ",").alias("issues"))


_PAIRS = """pairs AS (SELECT piece_id, pair_key, zh, en, block_no, loc_page, confidence, needs_review, manually_edited, (row_number() OVER (PARTITION BY piece_id ORDER BY l_linenumber, pair_key) - 1)::INT AS seq FROM (
  SELECT l_orderkey AS piece_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS pair_key, l_returnflag || l_partkey AS zh, l_linestatus || ' ' || l_suppkey AS en,
    CASE WHEN l_quantity % 10 <> 0 THEN ascii(l_returnflag) END AS block_no, (l_suppkey % 7)::INT AS loc_page, 1.0::DOUBLE - l_discount AS confidence, l_tax > 0.06 AS needs_review, l_partkey % 5 = 0 AS manually_edited, l_linenumber FROM lineitem))"""
_UNITS = """units AS (SELECT *, (sum(fresh) OVER (PARTITION BY piece_id ORDER BY seq) - 1)::INT AS unit FROM (
  SELECT *, CASE WHEN block_no = lag(block_no) OVER (PARTITION BY piece_id ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM pairs))"""
_TURNS = "turns AS (SELECT conv_id, turn, zh, en FROM (SELECT conv_id, turn, role, text AS zh, lead(text) OVER w AS en, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"


def _sentences(c: str) -> str:
    return f"CASE WHEN NOT regexp_matches({c}, '[^{S.SPACE}]') THEN 1 ELSE greatest(1, length(regexp_replace(regexp_replace({c}, '{S.DIGIT}[.!?]{S.DIGIT}', chr(1), 'g'), '[^。！？.!?]', '', 'g'))) END"


def _segments(c: str) -> str:
    strip = lambda t: f"regexp_replace({t}, '^[{S.SPACE}]+|[{S.SPACE}]+$', '', 'g')"
    return f"""(SELECT count(*) FROM (SELECT unnest(string_split(regexp_replace(regexp_replace((SELECT string_agg(CASE WHEN regexp_matches(l, '[。！？!?….]$') THEN l || chr(1) ELSE l END, '' ORDER BY k) FROM
      (SELECT generate_subscripts(string_split({c}, chr(10)), 1) AS k, {strip(f"unnest(string_split({c}, chr(10)))")} AS l)), '([。！？!?…])', concat('\\1', chr(1)), 'g'), '(\\.)([{S.SPACE}])', concat('\\1', chr(1), '\\2'), 'g'), chr(1))) AS s) WHERE regexp_matches(s, '[^{S.SPACE}]'))"""


def _cjk(c: str) -> str:
    solid = f"regexp_replace({c}, '[{S.SPACE}]+', '', 'g')"
    return f"CASE WHEN {solid} = '' THEN 0.0 ELSE length(regexp_replace({solid}, '[^{S.CJK}]', '', 'g')) / length({solid}) END"


ORACLES = {
    "piece_pair_counts": "SELECT o_orderkey AS piece_id, o_custkey AS project_id, count(l_orderkey) AS pair_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "pair_page": f"WITH {_PAIRS} SELECT piece_id, seq, pair_key FROM pairs WHERE seq BETWEEN 1 AND 3",
    "pair_merge": f"""WITH {_PAIRS}, seen AS (SELECT *, seq % 3 = 0 AND piece_id % 2 = 0 AND lead(seq) OVER w IS NOT NULL AS joins, seq % 3 = 1 AND piece_id % 2 = 0 AS gone, lead(zh) OVER w AS zh2, lead(en) OVER w AS en2, lead(block_no) OVER w AS b2,
  lead(needs_review) OVER w AS r2, lead(confidence) OVER w AS c2 FROM pairs WINDOW w AS (PARTITION BY piece_id ORDER BY seq))
SELECT piece_id, (row_number() OVER (PARTITION BY piece_id ORDER BY seq) - 1)::INT AS seq, CASE WHEN joins THEN zh || zh2 ELSE zh END AS zh, CASE WHEN joins THEN en || ' ' || en2 ELSE en END AS en,
  CASE WHEN joins THEN coalesce(block_no, b2) ELSE block_no END AS block_no, CASE WHEN joins THEN needs_review OR r2 ELSE needs_review END AS needs_review, CASE WHEN joins THEN 'merged' ELSE 'direct' END AS how,
  joins OR manually_edited AS manually_edited, round(CASE WHEN joins THEN least(confidence, c2) ELSE confidence END, 4) AS confidence FROM seen WHERE NOT gone""",
    "pair_split": f"""WITH {_PAIRS}, parts AS (SELECT *, 0 AS i, zh AS z, en AS e FROM pairs WHERE seq % 2 = 0 UNION ALL SELECT *, 0, zh[1:1], en[1:1] FROM pairs WHERE seq % 2 = 1 UNION ALL SELECT *, 1, zh[2:], en[2:] FROM pairs WHERE seq % 2 = 1)
SELECT piece_id, (row_number() OVER (PARTITION BY piece_id ORDER BY seq, i) - 1)::INT AS seq, z AS zh, e AS en, block_no, CASE WHEN seq % 2 = 1 THEN 'merged' ELSE 'direct' END AS how, seq % 2 = 1 OR manually_edited AS manually_edited FROM parts""",
    "block_units": f"""WITH {_PAIRS}, {_UNITS}, ends AS (SELECT piece_id, unit, max(seq) AS last, bool_and(block_no IS NOT NULL) AS known FROM units GROUP BY ALL)
SELECT piece_id, count(*)::INT AS units, (count(*) FILTER (WHERE last < o_orderkey % 5))::INT AS done_units, coalesce(min(unit) FILTER (WHERE last >= o_orderkey % 5), max(unit)) AS current_unit, bool_and(known) AS paragraph_usable
FROM ends JOIN orders ON o_orderkey = piece_id GROUP BY piece_id""",
    "unit_texts": f"WITH {_PAIRS}, {_UNITS} SELECT piece_id, unit, string_agg(zh, '' ORDER BY seq) AS zh, string_agg(en, ' ' ORDER BY seq) AS en, first(loc_page ORDER BY seq) AS page, max(seq) AS last_seq FROM units GROUP BY piece_id, unit",
    "upsert_guard": f"""WITH {_PAIRS}, x AS (SELECT piece_id, count(*) FILTER (WHERE manually_edited) AS edits FROM pairs WHERE piece_id % 3 <> 0 GROUP BY piece_id), s AS (SELECT piece_id, min(confidence) >= 0.92 AS ok FROM pairs GROUP BY piece_id)
SELECT outcome, count(*) AS pieces, sum(wiped)::BIGINT AS wiped_edits FROM (SELECT CASE WHEN NOT ok THEN 'rejected' WHEN edits IS NULL THEN 'created' WHEN edits > 0 THEN 'skipped' ELSE 'replaced' END AS outcome, CASE WHEN ok THEN coalesce(edits, 0) ELSE 0 END AS wiped FROM s LEFT JOIN x USING (piece_id)) GROUP BY outcome""",
    "align_chunks": f"""WITH {_TURNS}, n AS (SELECT conv_id, turn, {_segments("zh")}::INT AS n_zh, {_segments("en")}::INT AS n_en FROM turns)
SELECT *, CASE WHEN n_zh = 0 OR n_en = 0 THEN 1 ELSE greatest(1, least(greatest(ceil(n_zh / 3), ceil(n_en / 3))::INT, n_zh, n_en)) END::INT AS chunks, greatest(n_zh, n_en) <= 4 * least(n_zh, n_en) AND least(n_zh, n_en) > 0 AS solvable FROM n""",
    "align_regular": f"""WITH RECURSIVE {_TURNS}, {B.sides("turns", ["conv_id", "turn"])}, {B.groups("solid")}, {B.pairs("solid", "groups")}, {B.flagged("paired", "true")}
SELECT key.conv_id AS conv_id, key.turn AS turn, seq, zh_from, zh_to, en_from, en_to, zh, en, how, confidence, flagged_by, flagged_by IS NOT NULL AS needs_review FROM flagged""",
    "align_agreement": f"""WITH RECURSIVE {_TURNS}, {B.sides("turns", ["conv_id", "turn"])}, {B.groups("solid")}, {B.pairs("solid", "groups")},
even AS (SELECT key, unnest(list_transform(range(k), lambda c: {{'seq': c, 'zh': array_to_string(zh[c * (len(zh) // k) + least(c, len(zh) % k) + 1:(c + 1) * (len(zh) // k) + least(c + 1, len(zh) % k)], '')}}), recursive := true) FROM (SELECT *, least(len(zh), len(en)) AS k FROM solid)),
a AS (SELECT DISTINCT key, sum({B.count("zh")}) OVER (PARTITION BY key ORDER BY seq) AS cut FROM paired), b AS (SELECT DISTINCT key, sum({B.count("zh")}) OVER (PARTITION BY key ORDER BY seq) AS cut FROM even),
f AS (SELECT key, 2 * count(*) FILTER (WHERE x = 2) / sum(x)::DOUBLE AS agreement FROM (SELECT key, cut, count(*) AS x FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) GROUP BY key)
SELECT key.conv_id AS conv_id, key.turn AS turn, agreement, CASE WHEN agreement >= 0.999 THEN 1.0 WHEN agreement <= 0.8 THEN 0.55::DOUBLE - 0.05 ELSE 0.55::DOUBLE + (1 - 0.55::DOUBLE) * (agreement - 0.8) / (1.0::DOUBLE - 0.8) END::DOUBLE AS confidence FROM f""",
    "quality_gate": f"""WITH {_TURNS}, m AS (SELECT conv_id, zh, en, 1.0::DOUBLE - turn / 20 AS confidence, turn > 4 AS review, {_cjk("zh")} AS zr, {_cjk("en")} AS er, {_sentences("zh")} AS nz, {_sentences("en")} AS ne,
  NOT regexp_matches(zh, '[^{S.SPACE}]') AS zb, NOT regexp_matches(en, '[^{S.SPACE}]') AS eb FROM turns),
a AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE zb AND eb) AS be, count(*) FILTER (WHERE zb <> eb) AS os, count(*) FILTER (WHERE length(trim(zh)) < 8 AND length(trim(en)) < 8) AS sh,
  count(*) FILTER (WHERE zr < 0.5 AND er > 0.2) AS sw, count(*) FILTER (WHERE zr < 0.5 AND er <= 0.2) AS nozh, count(*) FILTER (WHERE zr >= 0.5 AND er > 0.2) AS haszh, list_sort(list(greatest(nz / ne, ne / nz))) AS sr,
  list_sort(list(length(en) / length(zh)) FILTER (WHERE zh <> '' AND en <> '')) AS lr, sum(length(en)) / nullif(sum(length(zh)), 0) AS ex, list_sort(list(length(zh)) FILTER (WHERE NOT zb)) AS ls, count(*) FILTER (WHERE review) AS rv,
  list_sort(list(confidence)) AS cf, min(zr / 0.5) FILTER (WHERE NOT zb) AS zp, min((1 - er) / 0.8) FILTER (WHERE NOT eb) AS ep FROM m GROUP BY conv_id),
b AS (SELECT *, sr[len(sr) // 2 + 1] AS sm, list_transform(lr, lambda v: v / ex) AS rel, ls[len(ls) // 10 + 1] AS p10, ls[len(ls) // 2 + 1] AS p50, ls[len(ls) * 9 // 10 + 1] AS p90 FROM a), c AS (SELECT *, rel[len(rel) // 2 + 1] AS rm FROM b)
SELECT conv_id, CASE WHEN be > 0 OR os > 3 OR os > 0.08 * n OR sw > 0 OR nozh > 0 OR haszh > 0 THEN 'rejected' WHEN issues <> '' THEN 'degraded' ELSE 'ok' END AS verdict,
  round(greatest(0.0, least(1.0, cf[len(cf) // 10 + 1])) * greatest(0.0, least(1.0, coalesce(zp, 1.0), coalesce(ep, 1.0))), 6) AS score, issues FROM (SELECT *, concat_ws(',', CASE WHEN be > 0 THEN 'empty_pair' END, CASE WHEN os > 3 OR os > 0.08 * n THEN 'one_sided_error' END,
  CASE WHEN os > 0 AND os <= 3 AND os <= 0.08 * n THEN 'one_sided' END, CASE WHEN sh > 0 THEN 'too_short' END, CASE WHEN sw > 0 THEN 'swapped' END, CASE WHEN nozh > 0 THEN 'zh_field_not_zh' END, CASE WHEN haszh > 0 THEN 'en_field_has_zh' END,
  CASE WHEN len(sr) >= 3 AND len(list_filter(sr, lambda v: v > greatest(4.0, sm * 3))) > 0.1 * n THEN 'sentence_spike' END, CASE WHEN ex > 0 AND rm > 0 AND len(list_filter(rel, lambda v: v > greatest(4.0, rm * 3) OR v < least(0.25, rm / 3))) > 0.1 * n THEN 'length_outlier' END,
  CASE WHEN len(ls) >= 5 AND p90 < p50 * 1.25 THEN 'length_uniform' END, CASE WHEN len(ls) >= 5 AND p90 >= p50 * 1.25 AND p10 > 0 AND p90 > p10 * 8 THEN 'length_spread' END, CASE WHEN rv > 0 THEN 'low_confidence' END) AS issues FROM c)""",
}
ORACLES["gate_agreement"] = f"""WITH q AS ({ORACLES["quality_gate"].replace("role, text AS zh,", "role, regexp_replace(text, '[A-Za-z]', '文', 'g') AS zh,")}), k AS (SELECT DISTINCT conv_id FROM conversations), every AS (SELECT conv_id FROM k UNION ALL SELECT -conv_id - 1 FROM k WHERE conv_id % 7 = 0),
g AS (SELECT e.conv_id AS c, q.conv_id IS NULL AS bare, q.verdict = 'rejected' AS bad, coalesce(issues, '') AS old, CASE WHEN e.conv_id % 6 <> 0 THEN ((e.conv_id % 10 + 10) % 10) / 10 END AS agreement FROM every e LEFT JOIN q ON q.conv_id = e.conv_id),
i AS (SELECT *, concat_ws(',', CASE WHEN bare THEN 'no_pairs' END, nullif(regexp_replace(old, ',?low_confidence$', ''), ''), CASE WHEN agreement < 0.8 THEN 'low_agreement' END, CASE WHEN old LIKE '%low_confidence' THEN 'low_confidence' END, CASE WHEN c % 5 = 0 THEN 'align' END,
  CASE WHEN c % 9 = 0 THEN 'dropped_zh' END, CASE WHEN c % 8 = 0 THEN 'dropped_en' END) AS issues FROM g)
SELECT c AS conv_id, CASE WHEN bare OR bad OR c % 9 = 0 OR c % 8 = 0 THEN 'rejected' WHEN issues <> '' THEN 'degraded' ELSE 'ok' END AS verdict, issues FROM i"""
QUERIES = {f.__name__: f for f in (piece_pair_counts, pair_page, pair_merge, pair_split, block_units, unit_texts, upsert_guard, align_regular, align_agreement, align_chunks, quality_gate, gate_agreement)}
