"""Text functions: columns in, columns out, all JVM-side.

Patterns are spelled so that Java's and RE2's engines read them alike; white space and digits are Unicode's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes (inside of brackets).
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK_LETTERS = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"
CJK = CJK_LETTERS + r"\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
LATIN = r"A-Za-z\x{c0}-\x{24f}"
DIGIT = r"\p{Nd}"

# Thresholds of the language tests.
ZH_MIN_RATIO, FIELD_ZH_MIN, FIELD_EN_MAX = 0.3, 0.5, 0.2

# Lines that are page numbers, marks of accounts in page heads, and lines of signs alone.
_S, _N = f"[{SPACE}]*", f"{DIGIT}+"
PAGE_NUMBER = (
    f"第{_S}{_N}{_S}页{_S}[,，/]?{_S}共{_S}{_N}{_S}页",
    f"第{_S}{_N}{_S}页",
    f"(?:page|Page|PAGE)[{SPACE}]+{_N}({_S}(?:/|of){_S}{_N})?",
    f"-?{_S}{_N}{_S}-{_S}-?",
    f"{DIGIT}{{1,4}}",
)
WATERMARK_HINTS = ("gzh", "xhs", "公众号", "扫码", "加微信", "vx", "违者必究")
NOISE = rf"^[{SPACE}\-=_*#~·—–|]*$"

# Full-width signs and what they are folded to.
FULL_WIDTH, HALF_WIDTH = "，。！？：；（）“”　—", ',.!?:;()"" -'

#: The characters of ``SPACE``.
_SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: CJK characters that aren't white space.
_CJK_SOLID = CJK_LETTERS + r"\x{3001}-\x{303f}\x{ff00}-\x{ffef}"

#: Marks where lines end a sentence while segments are made; removed again.
BREAK = "\x01"


def once(value: Column) -> Column:
    """A value that is computed once a row. Spark moves filters below the columns that they look at and puts what makes these
    into the filter, again for each use; a generated column stays where it is. To be used in ``select`` or ``withColumn``."""
    return F.explode(F.array(value))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used (also within a list's function)."""
    return F.get(F.transform(F.array(value), use), 0)


def zero_filled(number: Column, width: int) -> Column:
    """A whole number of ``width`` digits at least, as ``%0<width>d`` writes it."""
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(_SPACES))


def fold_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def fold_all(text: Column) -> Column:
    return F.replace(F.translate(fold_space(text), FULL_WIDTH, HALF_WIDTH), F.lit("…"), F.lit("..."))


def in_source(quote: Column, source: Column) -> Column:
    """Whether the quote stands in the source, white space aside, or else full-width forms aside, too."""
    return F.contains(fold_space(source), fold_space(quote)) | F.contains(fold_all(source), fold_all(quote))


def _count(text: Column, chars: str) -> Column:
    """Characters of a class, by what is left without them (no match becomes a string of its own)."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def zh_ratio(text: Column) -> Column:
    """Chinese (or other CJK) characters among these and Latin letters; 0 for empty texts, 1 without either."""
    zh, en = _count(text, CJK), _count(text, LATIN)
    plain = F.when(text.rlike("[A-Za-z]"), 0.0).otherwise(1.0)
    return F.when(F.length(text) == 0, 0.0).when(_is_ascii(text), plain).when(zh + en == 0, 1.0).otherwise(zh / (zh + en))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def clamped_ratio(text: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), zh_ratio(text)))


def language(text: Column, threshold: float = ZH_MIN_RATIO) -> Column:
    return language_of(zh_ratio(text), threshold)


def language_of(ratio: Column, threshold: float = ZH_MIN_RATIO) -> Column:
    return F.when(ratio >= threshold, "zh").otherwise("en")


def cjk_ratio(text: Column) -> Column:
    """CJK characters among all that aren't white space; 0 for blank texts."""
    ratio = F.try_divide(_count(text, _CJK_SOLID), F.length(fold_space(text)))
    return F.when(_is_ascii(text), 0.0).when(text.isNotNull(), F.coalesce(ratio, F.lit(0.0)))


def count_sentences(text: Column) -> Column:
    """Sentence ends, those between digits left out; one at least."""
    inside = f"{DIGIT}[.!?]{DIGIT}"
    between = F.when(text.rlike(inside), F.regexp_count(text, F.lit(inside))).otherwise(0)
    return F.greatest(F.lit(1), _count(text, "。！？.!?") - between)


def estimate_tokens(text: Column) -> Column:
    """A CJK letter is a token, four other characters are one, and one more; 0 for empty texts."""
    cjk = F.when(_is_ascii(text), 0).otherwise(_count(text, CJK_LETTERS))
    return F.when(F.length(text) == 0, 0).otherwise(cjk + F.floor((F.length(text) - cjk) / 4) + 1).cast("long")


def is_page_number(line: Column) -> Column:
    return strip(line).rlike("^(?:" + "|".join(PAGE_NUMBER) + ")$")


def is_watermark(line: Column) -> Column:
    return F.lower(line).rlike("|".join(WATERMARK_HINTS))


def is_noise(line: Column) -> Column:
    return line.rlike(NOISE)


def junk_reason(line: Column) -> Column:
    """noise, page_no or watermark, the first that holds; null for other lines."""
    return F.when(is_noise(line), "noise").when(is_page_number(line), "page_no").when(is_watermark(line), "watermark")


def paragraphs(text: Column) -> Column:
    """Trimmed parts between blank lines, blank ones left out."""
    return F.filter(F.transform(F.split(text, rf"\n[{SPACE}]*\n", -1), strip), lambda p: F.length(p) > 0)


def _joined_lines(chunk: Column) -> Column:
    lines = F.filter(F.transform(F.split(chunk, "\n", -1), strip), lambda x: F.length(x) > 0)
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"[。！？!?….]\z"), F.concat(x, F.lit(BREAK))).otherwise(x)), "")


def segments(text: Column, min_length: int = 1) -> Column:
    """Sentences of a text. Blank lines part chunks; wrapped lines are joined without a space until one ends a sentence;
    sentences end after 。！？!?… and after . ! ? before white space. Shorter parts than ``min_length`` take on the next."""
    marked = lambda c: F.regexp_replace(_joined_lines(c), rf"([。！？!?…]|\.(?=[{SPACE}]))", f"$1{BREAK}")
    parts = F.transform(paragraphs(text), lambda c: F.filter(F.split(marked(c), BREAK, -1), lambda p: F.length(p) > 0))
    if min_length > 1:
        glue = lambda done, p: F.when((F.size(done) > 0) & (F.length(F.element_at(done, -1)) < min_length), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), p)))).otherwise(F.concat(done, F.array(p)))
        parts = F.transform(parts, lambda c: F.aggregate(c, F.array().cast("array<string>"), glue))
    return F.filter(F.transform(F.flatten(parts), strip), lambda s: F.length(s) > 0)


def scrub(text: Column, limit: int = 300) -> Column:
    """Keys and other long tokens masked, then cut to the limit."""
    return F.left(F.regexp_replace(text, r"sk-[A-Za-z0-9_\-]{6,}|[A-Za-z0-9_\-]{32,}", "***"), F.lit(limit))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def _halves(text: Column, cut: Column) -> Column:
    return F.struct(F.left(text, cut).alias("a"), F.substring(text, cut + 1, F.length(text)).alias("b"))


def split_zh_half(text: Column) -> Column:
    """(a, b): cut after the sentence end nearest to the middle; in the middle where there is none inside."""
    t = strip(text)
    size, middle = F.length(t), F.floor(F.length(t) / 2).cast("int")
    chars = F.split(t, "")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.get(chars, i - 1).rlike("[。！？…；;]"))
    nearest = F.array_min(F.transform(ends, lambda i: F.struct(F.abs(i - middle).alias("d"), i.alias("i"))))["i"]
    cut = F.when(nearest.isNull() | (nearest >= size), middle).otherwise(nearest)
    return F.when(size <= 1, F.struct(t.alias("a"), F.lit("").alias("b"))).otherwise(_halves(t, cut))


def split_en_half(text: Column, ratio: Column) -> Column:
    """(a, b): cut at the ratio, one character from either end at least."""
    t = strip(text)
    size = F.length(t)
    target = F.least(size - 1, F.greatest(F.lit(1), F.floor(size * ratio).cast("int")))
    return F.when(size <= 1, F.struct(t.alias("a"), F.lit("").alias("b"))).otherwise(_halves(t, target))


def clamp_seconds(seconds: Column) -> Column:
    """Timer seconds between 10 and an hour; 180 for null."""
    return F.coalesce(F.least(F.lit(3600), F.greatest(F.lit(10), F.round(seconds))), F.lit(180)).cast("int")


def parse_clock(text: Column) -> Column:
    """Seconds of ``m:ss`` (either colon) or of plain seconds; null for anything else."""
    t = strip(text)
    form = rf"^([0-9]{{1,3}})[{SPACE}]*[:：][{SPACE}]*([0-9]{{1,2}})$"
    minutes, seconds = (F.regexp_extract(t, form, i).try_cast("int") for i in (1, 2))
    return F.when(t.rlike(form), F.when(seconds <= 59, clamp_seconds(minutes * 60 + seconds))).when(t.rlike("^[0-9]+$"), clamp_seconds(t.try_cast("double")))


def format_countdown(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("int")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60)


def relative_time(then: Column, now: Column) -> Column:
    """How long ago: text for null, under a minute, minutes, hours, under 30 days, else the date."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    unit = lambda n, word: F.concat(F.floor(seconds / n).cast("string"), F.lit(word))
    return (
        F.when(then.isNull(), "还没开始").when(seconds < 60, "刚刚").when(seconds < 3600, unit(60, " 分钟前"))
        .when(seconds < 86400, unit(3600, " 小时前")).when(seconds < 30 * 86400, unit(86400, " 天前")).otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def whole_json(text: Column) -> Column:
    """A text as VARIANT if all of it is one JSON value, else null. The parser stops at the end of a value; with something known
    behind it, nothing else can follow."""
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "end of answer"]'))), "$", "array<variant>")
    alone = lambda v: F.when((F.size(v) == 2) & (F.try_variant_get(F.get(v, 1), "$", "string") == "end of answer"), F.get(v, 0))
    return named(both, alone)


def _near(value: Column) -> Column:
    """A number without its fraction; those beyond 18 digits are the largest with so many."""
    return F.greatest(F.lit(-1e18), F.least(F.lit(1e18), F.try_variant_get(value, "$", "double"))).cast("bigint")


def whole_number(value: Column) -> Column:
    """A VARIANT as a whole number if it was written as one (truth values count, 1.0 doesn't), else null."""
    return F.when(F.schema_of_variant(value).rlike(r"^(BIGINT|BOOLEAN|DECIMAL\((19|[23][0-9]),0\))$"), _near(value))


def as_number(value: Column) -> Column:
    """A VARIANT as a whole number: whole and broken ones, truth values, digits in quotes; null for all else."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    digits = F.when(text.rlike("^ *[+-]?[0-9]+ *$"), F.trim(text).try_cast("bigint"))
    return F.when(kind.rlike("^(BIGINT|BOOLEAN|DOUBLE|DECIMAL)"), _near(value)).when(kind == "STRING", digits)
