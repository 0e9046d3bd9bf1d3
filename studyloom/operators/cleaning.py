"""Page cleaning: page numbers, account marks and noise go; text stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

HEAD_LINES, FOOT_LINES = 1, 2


def _reason(line: Column, at: Column, head: Column) -> Column:
    placed = (at < HEAD_LINES + FOOT_LINES) | (line == head)
    return F.when(X.is_noise(line), "noise").when(X.is_page_number(line), "page_no").when(placed & X.is_watermark(line), "watermark")


def page_line_reasons(lines: Column) -> Column:
    """For each of a page's lines why it goes (noise, page_no, watermark), or null. A mark in the first line goes wherever
    that line stands again; other marks go in the first three lines alone."""
    head = F.get(lines, F.lit(0))
    return F.transform(lines, lambda x, i: _reason(x, i, head))


def kept_lines(lines: Column) -> Column:
    """The lines of a page that stay, each judged once."""
    head = F.get(lines, F.lit(0))
    return F.filter(lines, lambda x, i: _reason(x, i, head).isNull())


def with_clean_lines(pages: DataFrame, lines: str = "lines") -> DataFrame:
    """The pages with ``reasons`` and ``kept``; no shuffle, a page is one row."""
    return pages.withColumns({"reasons": page_line_reasons(F.col(lines)), "kept": kept_lines(F.col(lines))})


def clean_group(lines: Column, edge: Column) -> Column:
    """The lines of a paragraph group that stay; account marks go only at a page's edge."""
    return F.filter(lines, lambda x: X.junk_reason(x).isNull() | ((X.junk_reason(x) == "watermark") & ~edge))


def page_groups(layout: Column) -> Column:
    """Arrays of lines between blank lines of a page's layout text."""
    bare = F.array_join(F.transform(F.split(layout, "\n", -1), lambda x: F.when(X.is_blank(x), "").otherwise(x)), "\n")
    groups = F.split(F.regexp_replace(bare, "^\n+|\n+$", ""), "\n\n+", -1)
    return F.transform(F.filter(groups, lambda g: g != ""), lambda g: F.split(g, "\n", -1))


def drop_junk_groups(groups: Column) -> Column:
    """The groups without junk; the first and the last are the page's edges."""
    kept = F.transform(groups, lambda g, i: clean_group(g, (i == 0) | (i == F.size(groups) - 1)))
    return F.filter(kept, lambda g: F.size(g) > 0)


def page_blocks(pages: DataFrame, keys: list[str], lines: str = "lines") -> DataFrame:
    """One block of the kept lines for each page that has any."""
    clean = pages.withColumn("_lines", X.once(F.col(lines))).withColumn("kept", X.once(kept_lines(F.col("_lines"))))
    return clean.where(F.size("kept") > 0).select(*keys, F.array_join("kept", "\n").alias("text"))
