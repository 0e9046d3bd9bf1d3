"""Queries over texts: profiles, cleaning, segments, costs, files, quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cleaning, jobs, quotes
from ..session import table
from ..sources import documents as D
from . import forms as S

PRICES = [("src0", "base", 2.0, 8.0), ("src0", "fast", 0.5, 0.5), ("src1", "base", 12.0, 12.0), ("src1", "large", 1.0, 3.0)]


def spread(rows: DataFrame) -> DataFrame:
    """A small table of one file and row group is one task; its rows are dealt out where cores would stay idle."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, language, sentences and estimated tokens of every document."""
    t = F.col("text")
    measured = _documents(spark, sf_dir, "doc_id", "text").select("doc_id", X.zh_ratio(t).alias("zh_ratio"), X.cjk_ratio(t).alias("cjk_ratio"), X.count_sentences(t).cast("long").alias("sentences"), X.estimate_tokens(t).alias("tokens"))
    return measured.select("doc_id", "zh_ratio", X.language_of(F.col("zh_ratio")).alias("language"), "cjk_ratio", "sentences", "tokens")


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one page: lines kept and dropped."""
    pages = _documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    clean = cleaning.with_clean_lines(pages)
    count = lambda r: F.size(F.filter("reasons", lambda x: x == r)).cast("long").alias(r)
    return clean.select("doc_id", F.size("kept").cast("long").alias("kept"), count("noise"), count("page_no"), count("watermark"), F.md5(F.array_join("kept", "\n")).alias("digest"))


def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text").select("doc_id", X.segments(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("segments"), F.md5(F.array_join("s", "\n")).alias("digest"))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.count_sentences(F.col("text")).cast("long")
    return _documents(spark, sf_dir, "lang", "text").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(n).alias("sentences"), F.max(n).alias("most"))


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated costs by source as provider, at three kinds of price: exact, the provider's lowest, the fallback."""
    t = F.col("text")
    docs = _documents(spark, sf_dir, "source", "lang", "text").select(F.col("source").alias("provider"), F.when(F.col("lang") == "en", "base").otherwise("other").alias("model"), X.estimate_tokens(t).alias("prompt_tokens"), (X.count_sentences(t) * 8).cast("long").alias("completion_tokens"))
    sums = docs.groupBy("provider", "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    priced = jobs.with_prices(sums, PRICES)
    return priced.withColumn("cost", F.round(jobs.cost(F.col("prompt_tokens"), F.col("completion_tokens")), 8))


def file_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha256"), "doc_id")
    return D.first_files(files, "source", ["doc_id"]).withColumn("path", D.content_path(F.col("sha256"), F.lit(".TXT")))


def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the benchmark passages that stand in it."""
    return quotes.standing(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", F.md5(X.scrub(t)).alias("scrubbed"), X.truncate(t, 40).alias("short"), F.md5(X.split_en_half(t, F.lit(0.5))["a"]).alias("half"))


def _ratio(cjk: str, text: str = "text") -> str:
    return f"length(regexp_replace({text}, '[^{cjk}]', '', 'g'))"


_SENTENCES = f"CASE WHEN NOT regexp_matches(text, '[^{S.SPACE}]') THEN 1 ELSE greatest(1, length(regexp_replace(regexp_replace(text, '{S.DIGIT}[.!?]{S.DIGIT}', chr(1), 'g'), '[^。！？.!?]', '', 'g'))) END"
_TOKENS = f"CASE WHEN length(text) = 0 THEN 0 ELSE {_ratio(S.CJK_LETTERS)} + (length(text) - {_ratio(S.CJK_LETTERS)}) // 4 + 1 END"
_FOLD = f"regexp_replace(text, '[{S.SPACE}]+', '', 'g')"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{S.SPACE}]+|[{S.SPACE}]+$', '', 'g')"


_FOLD_ALL = f"replace(translate({_FOLD}, '{S.FULL_WIDTH}', '{S.HALF_WIDTH}'), '…', '...')"

ORACLES = {
    "text_profile": f"""
SELECT doc_id, zh_ratio, CASE WHEN zh_ratio >= {S.ZH_MIN_RATIO} THEN 'zh' ELSE 'en' END AS language, cjk_ratio, sentences, tokens FROM (
  SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 WHEN {_ratio(S.CJK)} + {_ratio(S.LATIN)} = 0 THEN 1.0 ELSE {_ratio(S.CJK)} / ({_ratio(S.CJK)} + {_ratio(S.LATIN)}) END::DOUBLE AS zh_ratio,
    CASE WHEN length({_FOLD}) = 0 THEN 0.0 ELSE {_ratio(S.CJK, _FOLD)} / length({_FOLD}) END::DOUBLE AS cjk_ratio, {_SENTENCES} AS sentences, {_TOKENS} AS tokens FROM documents)""",
    "clean_lines": f"""
WITH pages AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), lined AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line, lines[1] AS head FROM pages
), judged AS (
  SELECT doc_id, i, line, CASE WHEN regexp_matches(line, '{S.NOISE}') THEN 'noise' WHEN regexp_matches({_strip("line")}, '^(?:{"|".join(S.PAGE_NUMBER)})$') THEN 'page_no'
    WHEN regexp_matches(lower(head), '{"|".join(S.WATERMARK_HINTS)}') AND line = head THEN 'watermark'
    WHEN regexp_matches(lower(line), '{"|".join(S.WATERMARK_HINTS)}') AND i <= 3 THEN 'watermark' END AS reason FROM lined
)
SELECT doc_id, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE reason = 'noise') AS noise, count(*) FILTER (WHERE reason = 'page_no') AS page_no,
  count(*) FILTER (WHERE reason = 'watermark') AS watermark, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE reason IS NULL), '')) AS digest FROM judged GROUP BY doc_id""",
    "sentence_segments": f"""
WITH chunks AS (
  SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS chunk FROM (SELECT doc_id, string_split_regex(text, '\\n[{S.SPACE}]*\\n') AS c FROM documents)
), lines AS (SELECT doc_id, i, generate_subscripts(l, 1) AS j, {_strip("unnest(l)")} AS line FROM (SELECT doc_id, i, string_split(chunk, chr(10)) AS l FROM chunks)
), joined AS (SELECT doc_id, i, string_agg(CASE WHEN regexp_matches(line, '[。！？!?….]$') THEN line || chr(1) ELSE line END, '' ORDER BY j) AS t FROM lines WHERE line <> '' GROUP BY doc_id, i
), marked AS (SELECT doc_id, i, regexp_replace(regexp_replace(t, '([。！？!?…])', concat('\\1', chr(1)), 'g'), '(\\.)([{S.SPACE}])', concat('\\1', chr(1), '\\2'), 'g') AS t FROM joined
), parts AS (SELECT doc_id, i, generate_subscripts(p, 1) AS j, {_strip("unnest(p)")} AS s FROM (SELECT doc_id, i, string_split(t, chr(1)) AS p FROM marked)
), kept AS (SELECT doc_id, count(*) AS segments, string_agg(s, chr(10) ORDER BY i, j) AS t FROM parts WHERE s <> '' GROUP BY doc_id)
SELECT d.doc_id, coalesce(segments, 0) AS segments, md5(coalesce(t, '')) AS digest FROM documents d LEFT JOIN kept USING (doc_id)""",
    "sentence_stats": f"SELECT lang, count(*) AS documents, sum(n)::BIGINT AS sentences, max(n) AS most FROM (SELECT lang, {_SENTENCES} AS n FROM documents) GROUP BY lang",
    "token_cost": f"""
WITH used AS (SELECT source AS provider, CASE WHEN lang = 'en' THEN 'base' ELSE 'other' END AS model, sum({_TOKENS})::BIGINT AS prompt_tokens, sum({_SENTENCES} * 8)::BIGINT AS completion_tokens FROM documents GROUP BY ALL),
prices(p, m, i, o) AS (VALUES {", ".join(f"('{p}', '{m}', {i}::DOUBLE, {o}::DOUBLE)" for p, m, i, o in PRICES)}),
lowest AS (SELECT p, min((i, o)) AS x FROM prices GROUP BY p)
SELECT provider, model, prompt_tokens, completion_tokens, price_in, price_out, round(prompt_tokens / 1000000 * price_in + completion_tokens / 1000000 * price_out, 8) AS cost FROM (
  SELECT provider, model, prompt_tokens, completion_tokens, coalesce(i, x[1], 5.0)::DOUBLE AS price_in, coalesce(o, x[2], 20.0)::DOUBLE AS price_out
  FROM used LEFT JOIN prices ON provider = prices.p AND model = m LEFT JOIN lowest ON provider = lowest.p)""",
    "file_dedup": """
SELECT source, sha256, min(doc_id) AS doc_id, count(*) AS copies, sha256[1:2] || '/' || sha256[3:4] || '/' || sha256 || '.txt' AS path
FROM (SELECT source, sha256(text) AS sha256, doc_id FROM documents) GROUP BY source, sha256""",
    "quote_check": f"""
WITH d AS (SELECT doc_id, {_FOLD} AS a, {_FOLD_ALL} AS b FROM documents), q AS (SELECT item_id, {_FOLD} AS c, {_FOLD_ALL} AS e FROM benchmark)
SELECT doc_id, item_id FROM d JOIN q ON contains(a, c) OR contains(b, e)""",
    "scrubbed": f"""
SELECT doc_id, md5(regexp_replace(text, 'sk-[A-Za-z0-9_\\-]{{6,}}|[A-Za-z0-9_\\-]{{32,}}', '***', 'g')[1:300]) AS scrubbed, CASE WHEN length(text) > 40 THEN text[1:39] || '…' ELSE text END AS short,
  md5(CASE WHEN length(t) <= 1 THEN t ELSE t[1:least(length(t) - 1, greatest(1, length(t) // 2))] END) AS half FROM (SELECT doc_id, text, {_strip("text")} AS t FROM documents)""",
}
QUERIES = {f.__name__: f for f in (text_profile, clean_lines, sentence_segments, sentence_stats, token_cost, file_dedup, quote_check, scrubbed)}
