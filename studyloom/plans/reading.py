"""Queries over documents as they are read: lines to pieces, pages and files to blocks, and answers of models.

The tables hold no Chinese text, so a guide book is written for each customer from its orders: headings, greetings,
Chinese and English lines, all of them following from the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alignment, cleaning, graph, structure
from ..session import table
from ..sources import documents as D
from . import forms as S

NUMERALS = "一二三四五六七八九"


def _numeral(number) -> F.Column:
    return F.substring(F.lit(NUMERALS), (number % 9 + 1).cast("int"), 1)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, o, part, n, block, page, text): an order is a piece under a heading; of every fourth order an area's heading comes first, of
    every other fourth a zone's. Of every third order the heading stands behind a closing phrase in the same line. Chinese
    sentences come before English ones, two lines a block; the second English line has some Chinese in it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("o"), (F.col("o_orderkey") % 50).cast("int").alias("page"), "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("n"), "l_partkey").join(orders, "o")
    number, first, part = _numeral(F.col("o")), F.col("n") == 1, F.col("l_partkey").cast("string")
    row = lambda rows, place, n, block, text: rows.select("doc", "o", F.lit(place).alias("part"), n.alias("n"), block.cast("int").alias("block"), "page", text.alias("text"))
    zh = F.concat(F.when(first, "亲爱的游客朋友们，").otherwise(""), F.lit("我们来到"), _numeral(F.col("l_partkey")), _numeral(F.col("l_partkey") + 4), F.lit("湖 "), part, F.lit("。"))
    en = F.concat(F.when(first, "Dear tourists and friends, ").otherwise(""), F.lit("we are at lake "), part, F.when(F.col("n") == 2, " with 李明明").otherwise(""), F.lit(". "))
    head = F.concat(F.when(F.col("o") % 3 == 0, "再见，谢谢大家！").otherwise(""), F.lit("范文（"), number, F.lit("）"))
    parts = [
        row(orders.where("o % 4 = 0"), 0, F.lit(0), F.lit(0), F.concat(F.lit("（"), number, F.lit("）"), number, F.lit("江讲解"))),
        row(orders.where("o % 4 = 2"), 0, F.lit(0), F.lit(0), F.concat(F.lit("（"), number, F.lit("）"), number, F.lit("湖景区主要景点：甲、乙"))),
        row(orders, 1, F.lit(0), F.lit(0), head), row(lines, 2, F.col("n"), (F.col("n") - 1) / 2, zh), row(lines, 3, F.col("n"), F.col("n"), en),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks numbered through the book."""
    text = F.array_join(F.array_sort(F.collect_list(F.struct("n", "text")))["text"], "\n").alias("text")
    blocks = _lines(spark, sf_dir).groupBy("doc", "o", "part", "block", "page").agg(text)
    by = Window.partitionBy("doc").orderBy("o", "part", "block")
    return blocks.withColumn("block_no", (F.row_number().over(by) - 1).cast("int"))


def guide_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified lines of every book."""
    return structure.scan(_blocks(spark, sf_dir).select("doc", "block_no", "page", "text"), ["doc"]).select("doc", "n", "kind", "title", "section", "page", "block_no")


def guide_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one language."""
    runs = structure.language_runs(structure.scan(_blocks(spark, sf_dir).select("doc", "block_no", "page", "text"), ["doc"]), ["doc"])
    return runs.select("doc", "section", "run", "lang", "page", F.md5("raw").alias("raw"), F.size("line_blocks").alias("lines"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pieces(structure.scan(_blocks(spark, sf_dir).select("doc", "block_no", "page", "text"), ["doc"]), ["doc"])


def guide_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with both texts, and character maps by their sizes and ends."""
    ends = [F.size(f"{s}_blocks").alias(f"{s}_chars") for s in ("zh", "en")] + [f(f"{s}_blocks").alias(f"{s}_{n}") for s in ("zh", "en") for n, f in (("first", F.array_min), ("last", F.array_max))]
    return _pieces(spark, sf_dir).select("doc", "piece", "title", "area", "page", "zh_page", "en_page", F.md5("zh").alias("zh"), F.md5("en").alias("en"), *ends)


def guide_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of pieces as stored pairs without blocks, which are computed from the pieces' maps."""
    pieces = _pieces(spark, sf_dir).select(F.concat_ws("-", "doc", "piece").alias("id"), F.col("zh").alias("text"), F.col("zh_blocks").alias("owners"))
    pairs = pieces.select("id", F.posexplode(F.split("text", "\n+")).alias("seq", "zh"), F.lit(None).cast("int").alias("block_no"))
    return structure.backfill_blocks(pairs, pieces, "id").select("id", "seq", "block_no")


def chat_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts with a headed section for each turn."""
    turn = F.struct("turn", F.concat(F.lit("=== "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit(" ===\n"), "text").alias("t"))
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(turn))["t"], "\n").alias("text")).withColumn("title", F.lit("t"))
    return structure.graph_units(texts).select("conv_id", "unit", "unit_title", F.md5("body").alias("body"))


def _file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files: a byte order mark, and a blank line between lines."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.lit("\r\n\r\n"))), "UTF-8").alias("content"))
    return D.text_blocks(files, ["doc_id"])


def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _file_blocks(spark, sf_dir)
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max("block_no").alias("last"), F.max("page").alias("page"), F.round(F.sum("zh_ratio"), 6).alias("ratios"))


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each file as one text again."""
    return D.raw_text(_file_blocks(spark, sf_dir), ["doc_id"]).select("doc_id", F.md5("text").alias("text"))


def readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reader takes a file named like each part, by the last word of its name as extension."""
    path = F.concat(F.lit("/in/"), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, (".TXT", ".md", ".pdf", ".docx", ""))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", D.reader_of(path).alias("reader"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of their customers' books: a page number, lines in groups of three, a mark at the foot. The layout
    text has wide gaps, the plain text single blanks."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("n"), "l_partkey")
    text = lambda gap: F.concat(F.lit(f"line{gap}"), F.col("n").cast("string"), F.lit(gap), F.col("l_partkey").cast("string"), F.when(F.col("n") % 3 == 0, "\n").otherwise(""))
    whole = lambda gap: F.array_join(F.array_sort(F.collect_list(F.struct("n", text(gap).alias("t"))))["t"], "\n")
    pages = lines.groupBy("l_orderkey").agg(whole("   ").alias("a"), whole(" ").alias("b")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    frame = lambda c: F.concat(F.lit("第 "), F.col("o_orderkey").cast("string"), F.lit(" 页\n\n"), c, F.lit("\n\n公众号 x\n"))
    return pages.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), frame("a").alias("layout"), frame("b").alias("plain"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages."""
    return D.page_blocks(_pages(spark, sf_dir), ["doc"]).select("doc", "block_no", "page", "text", "zh_ratio")


def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pages_json(D.page_blocks(_pages(spark, sf_dir), ["doc"]), ["doc"]).select("doc", F.md5("pages").alias("pages"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept lines of each page as one block, without groups."""
    pages = _pages(spark, sf_dir).select("doc", "page", F.filter(F.split("plain", "\n"), lambda x: x != "").alias("lines"))
    return cleaning.page_blocks(pages, ["doc", "page"]).select("doc", "page", F.md5("text").alias("text"))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pieces of as many sentences of one size on either side as they have lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    numbered = lambda form: F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit(form), F.lpad(i.cast("string"), 4, "0"), F.lit("。" if form > "z" else ".")))
    return lines.select(F.col("l_orderkey").alias("id"), "n", numbered("第").alias("zh"), numbered("no ").alias("en"))


def align_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of asking a model to map every piece."""
    return alignment.estimated_tokens(_sides(spark, sf_dir), ["id"])


def align_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pieces whose English is missing for every third: sentences that no pair holds, and what is covered."""
    rows = _sides(spark, sf_dir).withColumn("en", F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("en")))
    lost = alignment.dropped(rows, ["id"])
    pairs = rows.select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("n")).alias("pairs")).join(lost, "id", "left")
    return pairs.select("id", F.coalesce("dropped_zh", F.lit(0)).alias("dropped_zh"), F.coalesce("dropped_en", F.lit(0)).alias("dropped_en"), alignment.coverage(F.col("pairs"), F.coalesce("dropped_zh", F.lit(0))).alias("coverage"))


def graph_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for orders: a node for each line, of which every fourth quotes what isn't there; links to the next node."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("n"), F.col("l_partkey").cast("string").alias("part"))
    quote = F.when(F.col("n") % 4 == 0, "elsewhere").otherwise(F.concat(F.lit("part "), "part"))
    node = F.struct(
        "n", F.concat(F.lit(" p"), "part").alias("name"), F.lit("s").alias("summary"), quote.alias("quote"), F.col("n").alias("weight"), (F.col("n") % 3).alias("category_index"),
        F.array(F.struct(F.col("n").alias("index"), F.lit(" next ").alias("reason")), F.struct((F.col("n") - 1).alias("index"), F.lit("own").alias("reason"))).alias("links"),
    )
    units = lines.groupBy("project").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.array_join(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("part  "), "part").alias("t"))))["t"], "\n").alias("body"))
    answer = F.to_json(F.struct(F.array(F.lit("甲"), F.lit(" 乙 "), F.lit("甲")).alias("categories"), F.col("nodes")))
    told = units.select("project", F.lit(0).alias("unit"), "body", F.when(F.col("project") % 5 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(F.col("project") % 5 == 1, "no").otherwise(answer).alias("answer"))
    nodes = graph.checked_nodes(graph.answers_to_units(told), ["project", "unit"])
    return nodes.select("project", "node", "name", "quote", "weight", "category", F.array_join(F.transform("links", lambda x: F.concat(x["to"].cast("string"), F.lit(" "), x["reason"])), ",").alias("links"))


_LINED = "lined AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_partkey AS p FROM lineitem)"
_N = lambda x: f"'{NUMERALS}'[({x}) % 9 + 1]"
_BOOK = f"""{_LINED}, book AS (
  SELECT o_custkey AS doc, o_orderkey AS o, 0 AS part, 0 AS n, 0 AS block, 'area' AS kind, {_N("o_orderkey")} || CASE WHEN o_orderkey % 4 = 0 THEN '江' ELSE '湖' END AS title, '' AS text FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey, o_orderkey, 1, 0, 0, 'closing', NULL, '再见，谢谢大家！' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_custkey, o_orderkey, 1, 1, 0, 'piece', {_N("o_orderkey")}, '' FROM orders
  UNION ALL SELECT o_custkey, o, 2, n, (n - 1) // 2, 'zh', NULL, CASE WHEN n = 1 THEN '亲爱的游客朋友们，' ELSE '' END || '我们来到' || {_N("p")} || {_N("p + 4")} || '湖 ' || p || '。' FROM lined JOIN orders ON o_orderkey = o
  UNION ALL SELECT o_custkey, o, 3, n, n, 'en', NULL, CASE WHEN n = 1 THEN 'Dear tourists and friends, ' ELSE '' END || 'we are at lake ' || p || CASE WHEN n = 2 THEN ' with 李明明' ELSE '' END || '. ' FROM lined JOIN orders ON o_orderkey = o
), b AS (
  SELECT *, (o % 50)::INT AS page, (dense_rank() OVER (PARTITION BY doc ORDER BY o, part, block) - 1)::INT AS block_no, (row_number() OVER w - 1)::INT AS place, count(*) FILTER (WHERE kind IN ('area', 'piece')) OVER w AS section,
    last_value(CASE WHEN kind = 'area' THEN title END IGNORE NULLS) OVER w AS area, last_value(CASE WHEN kind IN ('area', 'piece') THEN kind END IGNORE NULLS) OVER w AS under FROM book WINDOW w AS (PARTITION BY doc ORDER BY o, part, n)
), t AS (
  SELECT *, CASE kind WHEN 'en' THEN 'en' ELSE 'zh' END AS lang, dense_rank() OVER (PARTITION BY doc, section ORDER BY CASE kind WHEN 'zh' THEN 0 WHEN 'en' THEN 1 ELSE 2 END) - 1 AS run, CASE WHEN n <> 1 THEN text WHEN kind = 'zh' THEN text[10:] ELSE text[28:] END AS cut
  FROM b WHERE kind IN ('zh', 'en') OR (kind = 'closing' AND under = 'piece')
), heads AS (SELECT doc, section, title, area, page FROM b WHERE kind = 'piece')"""
_SOLID = lambda c: f"length(regexp_replace({c}, '[{S.SPACE}]+', '', 'g'))"
_SIDES = "sides AS (SELECT l_orderkey AS id, count(*)::INT AS n FROM lineitem GROUP BY 1)"
_PAGED = f"""{_LINED}, blocks AS (SELECT o_custkey AS doc, o_orderkey AS page, (n - 1) // 3 AS g, string_agg('line ' || n || ' ' || p, chr(10) ORDER BY n) AS text FROM lined JOIN orders ON o_orderkey = o GROUP BY ALL),
numbered AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY page, g) - 1)::INT AS block_no, page, text FROM blocks)"""
_ZH_RATIO = f"CASE WHEN length(t) = 0 THEN 0.0 WHEN length(regexp_replace(t, '[^{S.CJK}{S.LATIN}]', '', 'g')) = 0 THEN 1.0 ELSE length(regexp_replace(t, '[^{S.CJK}]', '', 'g')) / length(regexp_replace(t, '[^{S.CJK}{S.LATIN}]', '', 'g')) END::DOUBLE"
_PARAGRAPHS = f"p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, regexp_replace(unnest(l), '^[{S.SPACE}]+|[{S.SPACE}]+$', '', 'g') AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), kept AS (SELECT * FROM p WHERE t <> '')"
_PROMPT = """'块 1' || chr(10) || chr(10) || '甲方（' || n || '）' || chr(10) || (SELECT string_agg('[' || i || '] 第' || printf('%04d', i) || '。', chr(10) ORDER BY i) FROM range(1, n + 1) r(i)) || chr(10) || chr(10) || '乙方（' || n || '）' || chr(10)
  || (SELECT string_agg('[' || i || '] no ' || printf('%04d', i) || '.', chr(10) ORDER BY i) FROM range(1, n + 1) r(i)) || chr(10) || chr(10) || '给出 JSON 数组，每项 {"zh": [...], "en": [...]}，甲方编号全部用到一次。'"""
_LETTERS = f"length(regexp_replace(t, '[^{S.CJK_LETTERS}]', '', 'g'))"
ORACLES = {
    "guide_scan": f"WITH {_BOOK} SELECT doc, place AS n, CASE WHEN kind IN ('zh', 'en') THEN 'body' WHEN kind = 'closing' THEN CASE WHEN under = 'piece' THEN 'body' ELSE 'note' END ELSE kind END AS kind, title, section, page, block_no FROM b",
    "guide_runs": f"WITH {_BOOK} SELECT doc, section, run::INT AS run, lang, min(page) AS page, md5(trim(string_agg(text, chr(10) ORDER BY place))) AS raw, count(*)::INT AS lines FROM t GROUP BY doc, section, run, lang",
    "guide_pieces": f"""WITH {_BOOK}, runs AS (SELECT doc, section, lang, run, min(page) AS page, trim(string_agg(cut, chr(10) ORDER BY place)) AS text FROM t GROUP BY ALL),
sides AS (SELECT doc, section, {", ".join(f"md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY run) FILTER (WHERE lang = '{s}'), '')) AS {s}, coalesce(arg_min(page, run) FILTER (WHERE lang = '{s}'), 0) AS {s}_page" for s in ("zh", "en"))} FROM runs GROUP BY ALL),
chars AS (SELECT doc, section, {", ".join(f"coalesce(sum({_SOLID('cut')}) FILTER (WHERE lang = '{s}'), 0)::INT AS {s}_chars, min(block_no) FILTER (WHERE lang = '{s}') AS {s}_first, max(block_no) FILTER (WHERE lang = '{s}') AS {s}_last" for s in ("zh", "en"))} FROM t GROUP BY ALL)
SELECT doc, section AS piece, CASE WHEN area IS NULL THEN '' ELSE area || '·' END || '范文（' || title || '）' AS title, coalesce(area, '') AS area, coalesce(nullif(zh_page, 0), nullif(en_page, 0), page) AS page, zh_page, en_page, zh, en, zh_chars, en_chars, zh_first, zh_last, en_first, en_last
FROM sides JOIN chars USING (doc, section) JOIN heads USING (doc, section)""",
    "guide_backfill": f"WITH {_BOOK} SELECT doc || '-' || section AS id, (row_number() OVER (PARTITION BY doc, section ORDER BY place) - 1)::INT AS seq, (dense_rank() OVER (PARTITION BY doc, section ORDER BY block_no) - 1)::INT AS block_no FROM t WHERE lang = 'zh'",
    "chat_sections": f"WITH s AS (SELECT conv_id, turn, role || ' ' || turn AS unit_title, regexp_replace(text, '^[{S.SPACE}]+|[{S.SPACE}]+$', '', 'g') AS body FROM conversations) SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS unit, unit_title, md5(body) AS body FROM s WHERE body <> ''",
    "file_blocks": f"WITH {_PARAGRAPHS} SELECT doc_id, count(*) AS blocks, (count(*) - 1)::INT AS last, 0 AS page, round(sum({_ZH_RATIO}), 6) AS ratios FROM kept GROUP BY doc_id",
    "file_texts": f"WITH {_PARAGRAPHS} SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY i)) AS text FROM kept GROUP BY doc_id",
    "readers": "SELECT p_partkey, ['text', 'text', 'pages', 'no_parser', 'no_parser'][p_partkey % 5 + 1] AS reader FROM part",
    "page_texts": f"WITH {_PAGED} SELECT doc, block_no, page, text, 0.0::DOUBLE AS zh_ratio FROM numbered",
    "page_json": f"""WITH {_PAGED}, p AS (SELECT doc, page, '{{"page":' || page || ',"blocks":[' || string_agg('{{"order":' || block_no || ',"kind":"body","text":"' || replace(text, chr(10), '\\n') || '","zh_ratio":0.0}}', ',' ORDER BY block_no) || ']}}' AS j FROM numbered GROUP BY doc, page)
SELECT doc, md5('[' || string_agg(j, ',' ORDER BY page) || ']') AS pages FROM p GROUP BY doc""",
    "page_lines": f"WITH {_LINED} SELECT o_custkey AS doc, o_orderkey AS page, md5(string_agg('line ' || n || ' ' || p, chr(10) ORDER BY n) || CASE WHEN max(n) >= 2 THEN chr(10) || '公众号 x' ELSE '' END) AS text FROM lined JOIN orders ON o_orderkey = o GROUP BY ALL",
    "align_cost": f"WITH {_SIDES}, q AS (SELECT id, n, {_PROMPT} AS t FROM sides) SELECT id, ({_LETTERS} + (length(t) - {_LETTERS}) // 4 + 1)::BIGINT AS prompt_tokens, (n * 16)::BIGINT AS completion_tokens FROM q",
    "align_loss": f"WITH {_SIDES} SELECT id, CASE WHEN id % 3 = 0 THEN n ELSE 0 END AS dropped_zh, 0 AS dropped_en, CASE WHEN id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS coverage FROM sides",
    "graph_answers": f"""WITH {_LINED}, u AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n) - 1 AS node, lead(n) OVER (PARTITION BY o ORDER BY n) AS after FROM lined WHERE n % 4 <> 0 AND o % 5 <> 1)
SELECT o AS project, node::INT AS node, 'p' || p AS name, 'part ' || p AS quote, (CASE WHEN n IN (1, 3) THEN n ELSE 2 END)::INT AS weight, CASE WHEN n % 3 = 1 THEN '乙' ELSE '甲' END AS category, CASE WHEN after = n + 1 THEN (node + 1) || ' next' ELSE '' END AS links FROM u""",
}
QUERIES = {f.__name__: f for f in (guide_scan, guide_runs, guide_pieces, guide_backfill, chat_sections, file_blocks, file_texts, readers, page_texts, page_json, page_lines, align_cost, align_loss, graph_answers)}
