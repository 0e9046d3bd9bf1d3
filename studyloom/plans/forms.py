"""The fixed values that the queries' SQL is written with, spelled out here so that it doesn't follow the library's own."""

from __future__ import annotations

# Character classes (inside of brackets).
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK_LETTERS = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
LATIN = r"A-Za-z\x{c0}-\x{24f}"
DIGIT = r"\p{Nd}"

# The share of Chinese from which a text is Chinese.
ZH_MIN_RATIO = 0.3

# Lines that are page numbers, marks of accounts, and lines of signs alone.
PAGE_NUMBER = (
    rf"第[{SPACE}]*\p{{Nd}}+[{SPACE}]*页[{SPACE}]*[,，/]?[{SPACE}]*共[{SPACE}]*\p{{Nd}}+[{SPACE}]*页",
    rf"第[{SPACE}]*\p{{Nd}}+[{SPACE}]*页",
    rf"(?:page|Page|PAGE)[{SPACE}]+\p{{Nd}}+([{SPACE}]*(?:/|of)[{SPACE}]*\p{{Nd}}+)?",
    rf"-?[{SPACE}]*\p{{Nd}}+[{SPACE}]*-[{SPACE}]*-?",
    r"\p{Nd}{1,4}",
)
WATERMARK_HINTS = ("gzh", "xhs", "公众号", "扫码", "加微信", "vx", "违者必究")
NOISE = rf"^[{SPACE}\-=_*#~·—–|]*$"

# Full-width signs and what they are folded to.
FULL_WIDTH, HALF_WIDTH = "，。！？：；（）“”　—", ',.!?:;()"" -'

# What clients may write, by entity.
WRITABLE = {
    "piece_progress": ("last_pos", "recited"),
    "pair_edit": ("zh", "en", "seq", "needs_review", "manually_edited"),
    "checkin": ("items_json",),
    "plan": ("title", "due_date", "status", "sort_order"),
    "goal": ("exam_date",),
    "node_mastery": ("mastery",),
    "node_category": ("category_id",),
}
