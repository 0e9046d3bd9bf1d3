"""Knowledge graphs: model answers to checked nodes, rules, merged drafts, edges, edits and the tables that are stored."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Lengths that fields are cut to, and the name of the category of things without one.
NAME, CATEGORY, SUMMARY, QUOTE, REASON, PARAGRAPHS = 200, 120, 600, 800, 200, 120
UNSORTED = "未分类"
NODE_NAMES = ("nodes", "knowledge_points", "knowledgePoints", "points", "items")


def prompt(title: Column, body: Column) -> Column:
    """The numbered paragraphs (the first 120) that a model is asked to read: a limit of the prompt, not of the data."""
    parts = F.slice(X.paragraphs(body), 1, PARAGRAPHS)
    listed = F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), p)), "\n")
    return F.concat(F.lit("《"), title, F.lit("》，段落 "), F.size(parts).cast("string"), F.lit(" 个\n"), listed)


def json_object(answer: Column) -> Column:
    """The text from the first brace to the last, inside a fence if there is one; null without such."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(answer)
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def answers_to_units(units: DataFrame, answer: str = "answer") -> DataFrame:
    """Units with ``categories`` and ``nodes`` as a model gave them, read as VARIANT; none of an answer that isn't one object. Things
    of odd types are left out or empty."""
    read = units.withColumn("_v", X.whole_json(json_object(F.col(answer))))
    listed = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    text = lambda v, path="$": F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    value = lambda v, path: F.try_variant_get(v, path, "variant")
    link = lambda x: F.struct(X.whole_number(value(x, "$.index")).try_cast("int").alias("index"), text(x, "$.reason").alias("reason"))
    node = lambda n: F.struct(
        n["raw"].alias("raw"), *(text(n["v"], f"$.{c}").alias(c) for c in ("name", "summary", "quote")), F.coalesce(X.as_number(value(n["v"], "$.weight")).try_cast("int"), F.lit(2)).alias("weight"),
        X.whole_number(value(n["v"], "$.category_index")).try_cast("int").alias("category_index"), F.coalesce(F.transform(F.filter(listed(n["v"], "$.links"), is_object), link), F.array().cast("array<struct<index:int,reason:string>>")).alias("links"),
    )
    found = F.coalesce(*(listed(F.col("_v"), f"$.{name}") for name in NODE_NAMES))
    placed = F.filter(F.transform(found, lambda v, i: F.struct(i.alias("raw"), v.alias("v"))), lambda n: is_object(n["v"]))
    kind = "array<struct<raw:int,name:string,summary:string,quote:string,weight:int,category_index:int,links:array<struct<index:int,reason:string>>>>"
    read = read.withColumn("_nodes", placed)
    categories = F.transform(listed(F.col("_v"), "$.categories"), lambda c: F.when(is_object(c), text(c, "$.name")).otherwise(text(c)))
    return read.withColumns({"categories": F.coalesce(categories, F.array().cast("array<string>")), "nodes": F.coalesce(F.transform("_nodes", node), F.array().cast(kind))}).drop("_v", "_nodes")


def normal_categories(names: Column) -> Column:
    """Trimmed names, blank and repeated ones left out, cut to their length; the unsorted category where none is left."""
    kept = F.transform(F.array_distinct(F.filter(F.transform(names, X.strip), lambda n: n != "")), lambda n: F.left(n, F.lit(CATEGORY)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(UNSORTED)))


def checked_nodes(units: DataFrame, keys: list[str], source: str = "body") -> DataFrame:
    """Usable nodes of units (``categories``, ``nodes``, text ``source``): those with name, summary and a quote that stands
    in the source. ``node`` counts the usable ones of a unit; ``links`` point to these, others are dropped."""
    named = units.withColumn("categories", normal_categories(F.col("categories"))).withColumns({"_source": X.fold_space(F.col(source)), "_folded": X.fold_all(F.col(source)), "_count": F.coalesce(F.array_max(F.transform("nodes", lambda n: n["raw"])) + 1, F.lit(0))})
    stands = lambda q: F.contains(F.col("_source"), X.fold_space(q)) | F.contains(F.col("_folded"), X.fold_all(q))
    solid = lambda n: (X.strip(n["name"]) != "") & (X.strip(n["summary"]) != "") & (X.strip(n["quote"]) != "") & stands(X.strip(n["quote"]))
    usable = named.withColumn("_usable", F.filter("nodes", solid)).withColumn("_raws", F.transform("_usable", lambda n: n["raw"]))
    # ``outer``, as the answers would be read a second time to see which units have nodes.
    rows = usable.select(*keys, "categories", "_raws", "_count", F.posexplode_outer("_usable").alias("node", "n")).where("node is not null")
    category = F.when(F.col("n.category_index").between(0, F.size("categories") - 1), F.col("n.category_index")).otherwise(0)
    weight = F.when(F.col("n.weight").isin(1, 3), F.col("n.weight")).otherwise(2)
    links = F.filter("n.links", lambda x: x["index"].isNotNull() & (x["index"] >= 0) & (x["index"] < F.col("_count")) & (x["index"] != F.col("n.raw")))
    first = lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, lambda y: y["index"]), x["index"]) == i + 1)
    clean = F.filter(first(links), lambda x: (X.strip(x["reason"]) != "") & F.array_contains("_raws", x["index"]))
    final = F.transform(clean, lambda x: F.struct((F.array_position("_raws", x["index"]) - 1).cast("int").alias("to"), F.left(X.strip(x["reason"]), F.lit(REASON)).alias("reason")))
    cut = lambda c, n: F.left(X.strip(F.col(f"n.{c}")), F.lit(n)).alias(c)
    return rows.select(*keys, "node", cut("name", NAME), cut("summary", SUMMARY), cut("quote", QUOTE), weight.alias("weight"), F.get("categories", category).alias("category"), final.alias("links"))


def rule_category(rules: list[dict], file_name: Column, unit_title: Column) -> Column:
    """The category of the first rule that fits, null where none does. ``rules``: dicts of id, priority, match_on
    (file_name or unit_title), kind (prefix, contains, regex), pattern, category, enabled. They are a user's short list
    and become one expression that ends at the first hit. Disabled rules, blank and invalid patterns never fit."""
    out = None
    for rule in sorted(rules, key=lambda r: (r.get("priority", 0), r["id"])):
        text = unit_title if rule["match_on"] == "unit_title" else F.coalesce(file_name, F.lit(""))
        pattern = rule["pattern"]
        if not rule.get("enabled", True) or not pattern.strip():
            continue
        if rule["kind"] == "regex":
            try:
                re.compile(pattern)
            except re.error:
                continue
            fits = text.rlike(pattern)
        elif rule["kind"] in ("prefix", "contains"):
            fits = F.startswith(text, F.lit(pattern)) if rule["kind"] == "prefix" else F.contains(text, F.lit(pattern))
        else:
            continue
        out = F.when(fits, rule["category"]) if out is None else out.when(fits, rule["category"])
    return F.lit(None).cast("string") if out is None else out


def rule_rows(rules: list[dict]) -> list[dict]:
    """A rule set to store: the place is the priority. Blank and invalid patterns are refused."""
    for r in rules:
        if not r["pattern"].strip() or not r["category"].strip():
            raise ValueError("a rule needs a pattern and a category")
        if r["kind"] == "regex":
            re.compile(r["pattern"])
    return [r | {"priority": i} for i, r in enumerate(rules)]


def merge(nodes: DataFrame, keys: list[str], ruled: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, categories) of a draft for each of ``keys`` from units' nodes (``unit``, ``node``, ``category``, ``links``).
    A ruled unit's nodes all get the rule's category. Categories are one by name without white space, in order of first
    use; nodes get ``node_key`` and ``category_key`` and links to node keys. Nodes find their category by windows over their draft, so
    what made them runs once and they are shuffled once at most; such a sort spills."""
    rows, categories = _placed(nodes, keys, ruled)
    return rows.drop("sort_order", "first_name"), categories


def merged(nodes: DataFrame, keys: list[str], ruled: Column | None = None) -> DataFrame:
    """The nodes of :func:`merge` with ``sort_order`` and, in the first nodes of a category, its name as ``first_name``: one table to write, from
    which :func:`categories_of` reads the categories, so that what makes the nodes runs once for both."""
    return _placed(nodes, keys, ruled)[0]


def categories_of(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The categories of nodes as :func:`merged` gives them."""
    firsts = nodes.where("first_name is not null").groupBy(*keys, "category_key", "sort_order").agg(F.min("first_name").alias("name"))
    return firsts.select(*keys, "category_key", "name", "sort_order")


def _placed(nodes: DataFrame, keys: list[str], ruled: Column | None) -> tuple[DataFrame, DataFrame]:
    name = F.coalesce(ruled, F.col("category"), F.lit(UNSORTED)) if ruled is not None else F.coalesce("category", F.lit(UNSORTED))
    named = nodes.withColumns({"_name": name, "_folded": X.fold_space(name), "_at": F.struct("unit", "node")})
    first = named.groupBy(*keys, "_folded").agg(F.min_by("_name", "_at").alias("name"), F.min("_at").alias("_at"))
    placed = first.withColumn("sort_order", F.row_number().over(Window.partitionBy(*keys).orderBy("_at")) - 1)
    code = lambda n: F.concat(F.lit("c"), X.zero_filled(n, 3))
    categories = placed.withColumn("category_key", code(F.col("sort_order")))
    began = named.withColumn("_began", F.min("_at").over(Window.partitionBy(*keys, "_folded")))
    joined = began.withColumn("sort_order", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_began")) - 1)
    key = lambda n: F.concat(F.lit("u"), X.zero_filled(F.col("unit"), 3), F.lit(":n"), X.zero_filled(n, 2))
    links = F.transform("links", lambda x: F.struct(key(x["to"]).alias("to"), x["reason"].alias("reason")))
    kept = [c for c in nodes.columns if c not in (*keys, "category", "links")]
    own = F.when(F.col("_at").eqNullSafe(F.col("_began")), F.col("_name")).alias("first_name")
    rows = joined.select(*keys, *kept, key(F.col("node")).alias("node_key"), code(F.col("sort_order")).alias("category_key"), links.alias("links"), "sort_order", own)
    return rows, categories.select(*keys, "category_key", "name", "sort_order")


def edges(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Edges of node links: both ends exist, none to itself, one for each pair of nodes in either direction: the first, in
    the order of nodes and their links. Pairs are reduced map-side. Every node stands once among the links to it, as one without
    a place, so the nodes needn't be made a second time to see which ends exist."""
    here = F.struct(F.lit(None).cast("int").alias("l"), F.col("node_key").alias("to"), F.lit(None).cast("string").alias("reason"))
    placed = F.transform(F.coalesce("links", F.array().cast(nodes.schema["links"].dataType)), lambda x, i: F.struct(i.alias("l"), x["to"].alias("to"), x["reason"].alias("reason")))
    ends = nodes.select(*keys, F.struct(*order).alias("_n"), F.col("node_key").alias("from"), F.explode_outer(F.concat(F.array(here), placed)).alias("x"))
    ends = ends.select(*keys, "_n", "from", F.col("x.l").alias("_l"), F.col("x.to").alias("to"), F.col("x.reason").alias("reason"))
    there = F.max(F.col("_l").isNull()).over(Window.partitionBy(*keys, "to"))
    known = ends.withColumn("_there", there).where("_there and _l is not null and `from` <> `to`")
    pair = [F.least("from", "to").alias("_a"), F.greatest("from", "to").alias("_b")]
    first = known.groupBy(*keys, *pair).agg(F.min_by(F.struct("from", "to", "reason"), F.struct("_n", "_l")).alias("e"))
    return first.select(*keys, "e.from", "e.to", "e.reason")


def prune(categories: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Categories with nodes, numbered anew."""
    used = categories.join(nodes.select(*keys, "category_key").distinct(), [*keys, "category_key"], "left_semi")
    return used.withColumn("sort_order", F.row_number().over(Window.partitionBy(*keys).orderBy("sort_order", "category_key")) - 1)


def edited_nodes(nodes: DataFrame, categories: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes after ``edits`` (``node_key``, ``deleted``, ``to_category``, ``new_name``, ``new_summary``;
    nulls leave a thing as it is, and so do empty texts). A text that is blank after trimming deletes the node; unknown
    categories become the first one; edits of unknown nodes do nothing."""
    # A draft's categories are a short list; nodes meet them in one join.
    listed = categories.groupBy(*keys).agg(F.min_by("category_key", "sort_order").alias("_first"), F.collect_set("category_key").alias("_known"))
    # Edits that leave everything as it is needn't be moved.
    said = F.coalesce("deleted", F.lit(False)) | F.col("to_category").isNotNull() | (F.coalesce("new_name", F.lit("")) != "") | (F.coalesce("new_summary", F.lit("")) != "")
    joined = nodes.join(edits.where(said), [*keys, "node_key"], "left").where(~F.coalesce("deleted", F.lit(False)))
    given = {c: F.nullif(f"new_{c}", F.lit("")) for c in ("name", "summary")}
    joined = joined.withColumns({c: F.when(v.isNotNull(), F.left(X.strip(v), F.lit(n))).otherwise(F.col(c)) for (c, v), n in zip(given.items(), (NAME, SUMMARY), strict=True)} | {"_touched": given["name"].isNotNull() | given["summary"].isNotNull(), "_target": F.coalesce("to_category", "category_key")})
    joined = joined.where(~F.col("_touched") | ((F.col("name") != "") & (F.col("summary") != "")))
    moved = joined.join(listed, keys, "left")
    moved = moved.withColumns({"category_key": F.when(F.array_contains("_known", F.col("_target")), F.col("_target")).otherwise(F.col("_first")), "edited": F.col("_touched") | F.coalesce("edited", F.lit(False))}).where("category_key is not null")
    return moved.select(*dict.fromkeys([*nodes.columns, "edited"]))


def apply_edits(nodes: DataFrame, categories: DataFrame, edits: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, categories, edges) after ``edits`` (:func:`edited_nodes`)."""
    kept = edited_nodes(nodes, categories, edits, keys)
    return kept, prune(categories, kept, keys), edges(kept, keys, order)


def stored(nodes: DataFrame, categories: DataFrame, edge_rows: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The tables that replace the whole graphs of ``keys``; ids follow from keys, page 0 becomes null, drafts without
    nodes replace nothing."""
    ident = lambda c: F.md5(F.concat_ws("|", *keys, c))
    quotes = nodes.where("quote <> ''").select(*keys, ident("node_key").alias("node_id"), F.left("quote", F.lit(QUOTE)).alias("quote_text"), F.nullif("loc_page", F.lit(0)).alias("page"))
    return {
        "categories": categories.select(*keys, ident("category_key").alias("category_id"), "name", "sort_order"),
        "nodes": nodes.select(*keys, ident("node_key").alias("node_id"), ident("category_key").alias("category_id"), F.left("name", F.lit(NAME)).alias("name"), "weight", F.left("summary", F.lit(SUMMARY)).alias("card_summary")),
        "card_quotes": quotes,
        "edges": edge_rows.select(*keys, ident("from").alias("from_node"), ident("to").alias("to_node"), F.nullif(F.left("reason", F.lit(REASON)), F.lit("")).alias("reason")),
    }


def preview_groups(nodes: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """Groups of a preview by state (deleted, or the category they are to have), in order of first appearance."""
    groups = nodes.withColumn("state", state).groupBy(*keys, "state").agg(F.count("*").alias("nodes"), F.min(F.struct(*order)).alias("_first"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).drop("_first")
