"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame functions alone.

Labelled outcomes of pages (bad or not) are counted by host. A host's bad rate is shrunk towards its registered
domain's, that one's towards its suffix's, and that one's towards the overall rate; each prior is a beta distribution
whose strength is fitted at its level by moments of the beta-binomial. A host is blocked if the lower posterior bound of
its bad rate (mean less ``z`` standard deviations) is over ``limit``. Rules go first; the longest that fits decides.

Counts are pre-aggregated by task; joins are on host and domain, where AQE splits hot keys; fitted strengths are one
row a level. Defined results: a null url, or one without ``://``, has an empty host and path and is judged as the host
''; repeated pages count each; pages without a label count for no rate; a repeated label row counts as another outcome;
a host that is itself a public suffix is its own registered domain;
without any label every rate is the default of one half and nothing is blocked by reputation; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Public suffixes of several labels under which names are registered. Any other suffix is a last label.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw",
    "edu.au", "edu.cn", "go.jp", "gov.au", "gov.cn", "gov.uk", "ne.jp", "net.au", "net.uk", "or.jp", "or.kr", "org.au", "org.br", "org.nz",
    "org.uk", "org.za",
)
Z, LIMIT = 1.28, 0.35
STRENGTH = (0.5, 500.0)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """The pages with ``host`` and ``path``."""
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest comes last and outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """The host's suffix, the longest of ``suffixes`` or else its last label, and its registered domain, one label more."""
    suffix, domain = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    for n in sorted({x.count(".") + 1 for x in suffixes}):  # the longest comes last and outermost
        end = F.substring_index(host, ".", -n)
        known = end.isin([x for x in suffixes if x.count(".") + 1 == n])
        suffix, domain = F.when(known, end).otherwise(suffix), F.when(known, F.substring_index(host, ".", -n - 1)).otherwise(domain)
    return suffix, domain


def _strength(level: DataFrame, name: str) -> DataFrame:
    """One row: the strength of the prior above this level's groups, from the spread of their rates."""
    low, high = STRENGTH
    some = level.where("n > 0")
    s = some.agg(F.sum("n").alias("nn"), F.sum("x").alias("xx"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("x") * F.col("x") / F.col("n")).alias("xn"), F.count("*").alias("k"))
    p = F.expr("xx / nn")
    spread = (F.col("xn") - F.col("nn") * p * p) / (p * (1 - p)) - (F.col("k") - 1)
    room = F.col("nn") - F.col("n2") / F.col("nn") - (F.col("k") - 1)
    rho = F.when((p > 0) & (p < 1) & (room > 0), spread / room)
    fitted = F.when(rho <= 0, high).when(rho >= 1, low).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), 1 / rho - 1)))
    return s.select(F.coalesce(fitted, F.lit(high)).alias(name))


def reputations(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", outcome_id: str = "doc_id", bad: Column | None = None, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """A row for each host of ``pages`` (with ``host``): outcomes, bad ones, posterior mean and lower bound."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1) if bad is None else bad
    judged = outcomes.where(bad.isNotNull()).groupBy(F.col(outcome_id).alias("_id")).agg(F.count("*").alias("_n"), F.count_if(bad).alias("_x"))
    counted = pages.select(F.col(page_id).alias("_id"), "host").join(judged, "_id", "left")
    hosts = counted.groupBy("host").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("_x"), F.lit(0)).cast("double").alias("x"))
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    overall = tops.agg(F.coalesce(F.sum("x") / F.nullif(F.sum("n"), F.lit(0.0)), F.lit(0.5)).alias("p"))
    shrunk = lambda rate, m: (F.col("x") + F.col(m) * F.col(rate)) / (F.col("n") + F.col(m))
    # The overall rate and the strengths are scalar subqueries: aggregates without keys.
    s = tops.withColumns({"p": overall.scalar(), "m": _strength(tops, "m").scalar()}).select("suffix", shrunk("p", "m").alias("rate_s"))
    d = domains.join(s, "suffix").withColumn("m", _strength(domains, "m").scalar()).select("domain", shrunk("rate_s", "m").alias("rate_d"))
    h = hosts.join(d, "domain").withColumn("m", _strength(hosts, "m").scalar())
    a, b = F.col("m") * F.col("rate_d") + F.col("x"), F.col("m") * (1 - F.col("rate_d")) + F.col("n") - F.col("x")
    posterior = h.withColumns({"_a": a, "_b": b})
    t = F.col("_a") + F.col("_b")
    return posterior.select("host", "n", "x", (F.col("_a") / t).alias("mean"), (F.col("_a") / t - z * F.sqrt(F.col("_a") * F.col("_b") / (t * t * (t + 1)))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, limit: float = LIMIT, **settings) -> DataFrame:
    """Every page's id with ``host``, ``path``, ``rule``, ``verdict`` and the host's ``bound``."""
    parts = with_parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = reputations(parts, outcomes, "page_id", **settings).select("host", "bound")
    judged = parts.join(known, "host").withColumns({"rule": rule, "_rule_says": verdict})
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_rule_says", F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "bound")


SQL = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), judged AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE quality = 0 OR toxic = 1) AS x
  FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
), ends AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(x), 0)::DOUBLE AS x,
         regexp_extract(host, '[^.]*$') AS one, regexp_extract(host, '[^.]*\\.?[^.]*$') AS two, regexp_extract(host, '[^.]*\\.?[^.]*\\.?[^.]*$') AS three
  FROM parts LEFT JOIN judged ON page_id = doc_id GROUP BY host
), hosts AS (
  SELECT host, n, x, CASE WHEN two IN {SUFFIXES} THEN three ELSE two END AS domain, CASE WHEN two IN {SUFFIXES} THEN two ELSE one END AS suffix FROM ends
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY suffix),
overall AS (SELECT coalesce(sum(x) / nullif(sum(n), 0), 0.5) AS p FROM suffixes),
levels AS (
  SELECT 'h' AS level, n, x FROM hosts WHERE n > 0 UNION ALL SELECT 'd', n, x FROM domains WHERE n > 0
  UNION ALL SELECT 's', n, x FROM suffixes WHERE n > 0
), sums AS (
  SELECT level, sum(n) AS nn, sum(x) AS xx, sum(n * n) AS n2, sum(x * x / n) AS xn, count(*) AS k, sum(x) / sum(n) AS p FROM levels GROUP BY level
), rhos AS (
  SELECT level, CASE WHEN p > 0 AND p < 1 AND nn - n2 / nn - (k - 1) > 0
    THEN ((xn - nn * p * p) / (p * (1 - p)) - (k - 1)) / (nn - n2 / nn - (k - 1)) END AS rho FROM sums
), strengths AS (
  SELECT level, CASE WHEN rho IS NULL OR rho <= 0 THEN {STRENGTH[1]} WHEN rho >= 1 THEN {STRENGTH[0]}
    ELSE greatest({STRENGTH[0]}, least({STRENGTH[1]}, 1 / rho - 1)) END AS m FROM rhos
), s AS (
  SELECT suffix, (x + m * p) / (n + m) AS rate_s FROM suffixes, overall, (SELECT coalesce(max(m), {STRENGTH[1]}) AS m FROM strengths WHERE level = 's')
), d AS (
  SELECT domain, (x + m * rate_s) / (n + m) AS rate_d FROM domains JOIN s USING (suffix), (SELECT coalesce(max(m), {STRENGTH[1]}) AS m FROM strengths WHERE level = 'd')
), h AS (
  SELECT host, m * rate_d + x AS a, m * (1 - rate_d) + n - x AS b FROM hosts JOIN d USING (domain), (SELECT coalesce(max(m), {STRENGTH[1]}) AS m FROM strengths WHERE level = 'h')
), bounds AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h),
fits AS (
  SELECT *, CASE
    {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])))}
    END AS rule, CASE
    {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])))}
    END AS says FROM parts
)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM fits JOIN bounds USING (host)
"""
