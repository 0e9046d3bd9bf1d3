"""The gate before aligned pieces are stored: checks, verdict and score of every piece.

One shuffle by piece. Quantiles are read from sorted arrays at whole indexes, as the reference values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .alignment import AGREEMENT_FLOOR

# Limits of the checks.
ONE_SIDED_COUNT, ONE_SIDED_SHARE, SHORT, OUTLIER_SHARE, LEAST_SPREAD, MOST_SPREAD = 3, 0.08, 8, 0.1, 1.25, 8.0
#: Issues that refuse a piece; all others only degrade it.
ERRORS = ("no_pairs", "empty_pair", "one_sided_error", "swapped", "zh_field_not_zh", "en_field_has_zh", "dropped_zh", "dropped_en")


def _at(values: Column, index: Column) -> Column:
    return F.get(values, F.floor(index).cast("int"))


def gate(pairs: DataFrame, keys: list[str], pieces: DataFrame | None = None, floor: float = AGREEMENT_FLOOR) -> DataFrame:
    """``keys``, ``verdict`` (ok, degraded, rejected), ``score`` and ``issues`` (codes in order). ``pairs``: ``zh``, ``en``,
    ``confidence``, ``needs_review``. ``pieces`` may add pieces without pairs and ``agreement``, ``dropped_zh``,
    ``dropped_en`` and ``warnings`` (a count)."""
    zh, en = F.col("zh"), F.col("en")
    zh_blank, en_blank, zh_ratio, en_ratio = X.is_blank(zh), X.is_blank(en), X.cjk_ratio(zh), X.cjk_ratio(en)
    bad_zh, bad_en = zh_ratio < X.FIELD_ZH_MIN, en_ratio > X.FIELD_EN_MAX
    n_zh, n_en = X.count_sentences(zh), X.count_sentences(en)
    both = (zh != "") & (en != "")
    sums = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(zh_blank & en_blank).alias("both_empty"),
        F.count_if(zh_blank != en_blank).alias("one_sided"),
        F.count_if((F.length(X.strip(zh)) < SHORT) & (F.length(X.strip(en)) < SHORT)).alias("short"),
        F.count_if(bad_zh & bad_en).alias("swapped"),
        F.count_if(bad_zh & ~bad_en).alias("not_zh"),
        F.count_if(bad_en & ~bad_zh).alias("has_zh"),
        F.sort_array(F.collect_list(F.greatest(n_zh / n_en, n_en / n_zh))).alias("sentence_ratios"),
        F.sort_array(F.collect_list(F.when(both, F.length(en) / F.length(zh)))).alias("length_ratios"),
        (F.sum(F.length(en)) / F.nullif(F.sum(F.length(zh)), F.lit(0))).alias("expected"),
        F.sort_array(F.collect_list(F.when(~zh_blank, F.length(zh)))).alias("lengths"),
        F.count_if("needs_review").alias("review"),
        F.sort_array(F.collect_list("confidence")).alias("confidences"),
        F.min(F.when(~zh_blank, zh_ratio / X.FIELD_ZH_MIN)).alias("zh_purity"),
        F.min(F.when(~en_blank, (1 - en_ratio) / (1 - X.FIELD_EN_MAX))).alias("en_purity"),
    )
    extra = {"agreement": "double", "dropped_zh": "int", "dropped_en": "int", "warnings": "int"}
    if pieces is None:
        joined = sums.withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})
    else:
        given = pieces.select(*keys, *(F.col(c).cast(t).alias(c) if c in pieces.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()))
        joined = given.join(sums, keys, "left")
    n, zero = F.coalesce("n", F.lit(0)), F.lit(0)
    sentence, lengths = F.col("sentence_ratios"), F.col("lengths")
    middle = _at(sentence, F.size(sentence) / 2)
    spikes = F.size(F.filter(sentence, lambda v: v > F.greatest(F.lit(4.0), middle * 3)))
    relative = F.transform("length_ratios", lambda v: v / F.col("expected"))
    base = _at(relative, F.size(relative) / 2)
    outliers = F.size(F.filter(relative, lambda v: (v > F.greatest(F.lit(4.0), base * 3)) | (v < F.least(F.lit(0.25), base / 3))))
    low, mid, high = (_at(lengths, F.size(lengths) * k / 10) for k in (1, 5, 9))
    enough = F.size(lengths) >= 5
    dropped_zh, dropped_en = F.coalesce("dropped_zh", zero), F.coalesce("dropped_en", zero)
    tests = {
        "no_pairs": n == 0,
        "empty_pair": F.col("both_empty") > 0,
        "one_sided_error": (F.col("one_sided") > ONE_SIDED_COUNT) | (F.col("one_sided") > ONE_SIDED_SHARE * n),
        "one_sided": (F.col("one_sided") > 0) & (F.col("one_sided") <= ONE_SIDED_COUNT) & (F.col("one_sided") <= ONE_SIDED_SHARE * n),
        "too_short": F.col("short") > 0,
        "swapped": F.col("swapped") > 0,
        "zh_field_not_zh": F.col("not_zh") > 0,
        "en_field_has_zh": F.col("has_zh") > 0,
        "sentence_spike": (F.size(sentence) >= 3) & (spikes > OUTLIER_SHARE * n),
        "length_outlier": (F.col("expected") > 0) & (base > 0) & (outliers > OUTLIER_SHARE * n),
        "length_uniform": enough & (high < mid * LEAST_SPREAD),
        "length_spread": enough & (high >= mid * LEAST_SPREAD) & (low > 0) & (high > low * MOST_SPREAD),
        "low_agreement": F.col("agreement") < floor,
        "low_confidence": F.col("review") > 0,
        "align": F.col("warnings") > 0,
        "dropped_zh": dropped_zh > 0,
        "dropped_en": dropped_en > 0,
    }
    issues = F.filter(F.array(*(F.when(t, F.lit(c)) for c, t in tests.items())), lambda c: c.isNotNull())
    judged = joined.withColumn("issues", issues)
    bad = F.arrays_overlap("issues", F.array(*map(F.lit, ERRORS)))
    verdict = F.when(bad, "rejected").when(F.size("issues") > 0, "degraded").otherwise("ok")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    confidence = _at(F.col("confidences"), F.size("confidences") / 10)
    purity = F.least(F.lit(1.0), F.coalesce("zh_purity", F.lit(1.0)), F.coalesce("en_purity", F.lit(1.0)))
    score = clamp(confidence) * clamp(purity) * (1 - dropped_zh / (n + dropped_zh)) * F.coalesce("agreement", F.lit(1.0))
    return judged.select(*keys, verdict.alias("verdict"), F.when(n == 0, 0.0).otherwise(score).alias("score"), "issues")
