"""Queries over the answers of a model to alignment questions. The model is a script that follows from the question alone."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import model_alignment as M
from ..session import table
from . import balance_sql as B

BLOCK = 6


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order lines as three pieces: a sentence for each line on either side; every fifth English one is long."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    owned = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), "o_custkey"), "o").withColumn("id", F.col("o_custkey") * 3 + F.col("o") % 3)
    order = ["o", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = owned.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    number = F.lpad(F.col("n").cast("string"), 4, "0")
    zh = F.concat(F.lit("第"), F.col("id").cast("string"), F.lit("号"), number, F.lit("。"))
    en = F.concat(F.lit("no "), number, F.when(F.col("n") % 5 == 0, " and much more than all others say of it").otherwise(""), F.lit("."))
    listed = F.array_sort(F.collect_list(F.struct("n", zh.alias("zh"), en.alias("en"))))
    return rows.groupBy("id").agg(listed.alias("l")).select("id", F.col("l.zh").alias("zh"), F.col("l.en").alias("en"))


def scripted(messages: list[str]) -> tuple[str, int, int]:
    """Answers of eight kinds, by the piece that the question names; some are right at the second time only."""
    question, again = messages[1], len(messages) > 2
    block, kind, n = int(re.search(r"块 (\d+)", question)[1]), int(re.search(r"第(\d+)号", question)[1]) % 8, int(re.search(r"（(\d+)）", question)[1])
    ones = [[i, i] for i in range(1, n + 1)]
    twos = [{"zh": (own := list(range(i, min(i + 2, n + 1)))), "en_idx": own} for i in range(1, n + 1, 2)]
    if kind == 1 and not again:
        raise M.ModelError("network", "lost")
    if kind == 3:
        raise M.ModelError("auth", "no key")
    answer = {
        0: lambda: f"Here:\n```json\n{json.dumps([{'zh_indices': [i], 'en': i} for i in range(1, n + 1)])}\n```",
        1: lambda: json.dumps(ones),
        2: lambda: json.dumps(twos) if again else "no list",
        4: lambda: json.dumps(ones[::-1]),
        5: lambda: f"so {json.dumps(twos)} it is",
        6: lambda: json.dumps(ones[: n - 1] if block == 2 else ones),
        7: lambda: json.dumps([{"zh": str(i), "en": [i]} for i in range(1, n + 1)]),
    }[kind]()
    return answer, len(question), len(answer)


def mapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the model, or by balanced lengths where its answers stay wrong."""
    pairs = M.pairs(_pieces(spark, sf_dir), ["id"], scripted, size=BLOCK)
    return pairs.select("id", "seq", "zh_from", "zh_to", "en_from", "en_to", F.md5(F.concat("zh", F.lit("|"), "en")).alias("texts"), "how", F.round("confidence", 6).alias("confidence"), F.round("agreement", 9).alias("agreement"), "flagged_by", "needs_review", "error")


def mapped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every block: attempts, error and the number of groups."""
    asked = M.blocks(_pieces(spark, sf_dir), ["id"], size=BLOCK)
    return M.ask(asked, ["id"], scripted).select("id", "block", "attempts", "error", F.coalesce(F.size("groups"), F.lit(0)).alias("groups"), "zh_at")


_PIECES = """lines AS (SELECT o_custkey * 3 + l_orderkey % 3 AS id, row_number() OVER (PARTITION BY o_custkey * 3 + l_orderkey % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
solid AS MATERIALIZED (SELECT id AS key, list('第' || id || '号' || printf('%04d', n) || '。' ORDER BY n) AS zh, list('no ' || printf('%04d', n) || CASE WHEN n % 5 = 0 THEN ' and much more than all others say of it' ELSE '' END || '.' ORDER BY n) AS en FROM lines GROUP BY id),
cut AS (SELECT key, len(zh) AS n, ceil(len(zh) / 6)::BIGINT AS k FROM solid),
blocks AS (SELECT key, n, k, c AS block, c * (n // k) + least(c, n % k) AS first_at, n // k + CASE WHEN c < n % k THEN 1 ELSE 0 END AS take FROM cut, range(1000) r(c) WHERE c < k),
told AS (SELECT *, CASE key % 8 WHEN 3 THEN 'auth' WHEN 4 THEN CASE WHEN take > 1 THEN 'llm_not_monotonic' END WHEN 6 THEN CASE WHEN block = 1 THEN CASE WHEN take = 1 THEN 'llm_empty' ELSE 'llm_incomplete' END END WHEN 7 THEN 'llm_bad_shape' END AS error FROM blocks)"""

ORACLES = {
    "mapped_blocks": f"""WITH {_PIECES} SELECT key AS id, block::INT AS block, CASE WHEN key % 8 IN (1, 2) OR error LIKE 'llm%' THEN 2 ELSE 1 END::INT AS attempts, error,
  (CASE WHEN error IS NOT NULL THEN 0 WHEN key % 8 IN (2, 5) THEN ceil(take / 2) ELSE take END)::INT AS groups, first_at::INT AS zh_at FROM told""",
    "mapped_pairs": f"""WITH RECURSIVE {_PIECES}, {B.groups("solid")}, {B.pairs("solid", "groups")},
failed AS (SELECT key, arg_min(error, block) FILTER (WHERE error IS NOT NULL) AS error FROM told GROUP BY key),
llm AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY first_at, g) - 1 AS seq, first_at + g AS f, first_at + least(g + step, take) AS t FROM (SELECT *, CASE WHEN key % 8 IN (2, 5) THEN 2 ELSE 1 END AS step FROM told), range(6) r(g)
  WHERE g < take AND g % step = 0 AND key IN (SELECT key FROM failed WHERE error IS NULL)),
cuts AS (SELECT key, t AS c, 1 AS a, 0 AS b FROM llm UNION ALL SELECT key, zt, 0, 1 FROM groups),
agreed AS (SELECT key, 2 * sum(a * b) / sum(a + b)::DOUBLE AS agreement FROM (SELECT key, c, max(a) AS a, max(b) AS b FROM cuts GROUP BY ALL) GROUP BY key),
every AS (
  SELECT key, seq::INT AS seq, f::INT AS zh_from, t::INT AS zh_to, f::INT AS en_from, t::INT AS en_to, array_to_string(zh[f + 1:t], '') AS zh, array_to_string(en[f + 1:t], ' ') AS en, 'llm' AS how, 0.0::DOUBLE AS confidence FROM llm JOIN solid USING (key)
  UNION ALL SELECT p.* FROM paired p JOIN failed USING (key) WHERE error IS NOT NULL
), {B.flagged("every", "how <> 'llm'")},
rated AS (SELECT *, CASE WHEN how <> 'llm' THEN confidence WHEN agreement >= 0.999 THEN 1.0 WHEN agreement <= 0.8 THEN 0.5 ELSE round_even(0.55 + 0.45 * (agreement - 0.8) / 0.2, 3) END AS conf FROM flagged JOIN failed USING (key) JOIN agreed USING (key)),
marked AS (SELECT *, CASE WHEN how = 'llm' AND flagged_by = 'length_ratio' AND agreement >= 0.8 THEN NULL ELSE coalesce(flagged_by, CASE WHEN how = 'llm' AND conf < 0.55 THEN 'agreement' END) END AS flag FROM rated)
SELECT key AS id, seq, zh_from, zh_to, en_from, en_to, md5(zh || '|' || en) AS texts, how, round(conf, 6) AS confidence, CASE WHEN how = 'llm' THEN round(agreement, 9) END AS agreement, flag AS flagged_by, flag IS NOT NULL AS needs_review, error FROM marked""",
}
QUERIES = {f.__name__: f for f in (mapped_pairs, mapped_blocks)}
