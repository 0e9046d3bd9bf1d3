"""Writes as whole new tables: guarded replacement of pieces, edits of pairs, latest values, soft deletion.

Nothing is changed in place: every operator returns the rows that a partition or table is overwritten with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def outcomes(staged: DataFrame, existing: DataFrame, keys: list[str], overwrite: bool = False, also: tuple[Column, ...] = ()) -> DataFrame:
    """``staged`` pieces (``ok``: passed the gate) with ``outcome``: rejected, skipped (there are hand edits that would be
    lost), replaced or created, and ``wiped_edits``. ``existing``: ``manual_edits`` of each stored piece. ``also``: aggregates of
    these that come along."""
    there = existing.groupBy(*keys).agg(F.max("manual_edits").alias("_edits"), *also)
    joined = staged.join(there, keys, "left")
    edits = F.coalesce("_edits", F.lit(0))
    guarded = F.lit(not overwrite) & (edits > 0)
    outcome = F.when(~F.col("ok"), "rejected").when(F.col("_edits").isNull(), "created").when(guarded, "skipped").otherwise("replaced")
    return joined.withColumns({"outcome": outcome, "wiped_edits": F.when(F.col("ok"), edits).otherwise(F.lit(0))}).drop("_edits")


def replaced(existing: DataFrame, staged: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """The table afterwards: staged rows of created and replaced pieces, and existing rows of all others."""
    taken = decided.where(F.col("outcome").isin("created", "replaced")).select(*keys).distinct()
    return existing.join(taken, keys, "left_anti").unionByName(staged.join(taken, keys, "left_semi"))


def earliest_piece(pieces: DataFrame, keys: list[str], order: list[str], piece: str) -> DataFrame:
    """The earliest piece of each of ``keys`` (project, file, title)."""
    return pieces.groupBy(*keys).agg(F.min_by(piece, F.struct(*order)).alias(piece))


def next_sort_order(pieces: DataFrame, project: str, order: str = "sort_order") -> DataFrame:
    return pieces.groupBy(project).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_sort_order"))


def renumber(pairs: DataFrame, piece: str, order: list[str], seq: str = "seq") -> DataFrame:
    """``seq`` from 0 without gaps in the given order."""
    return pairs.withColumn(seq, (F.row_number().over(Window.partitionBy(piece).orderBy(*order)) - 1).cast("int"))


def new_key(*parts: Column) -> Column:
    """A key that follows from what it names."""
    return F.md5(F.concat_ws("|", *parts))


def split_pairs(pairs: DataFrame, cuts: DataFrame, piece: str, key: str = "pair_key") -> DataFrame:
    """Pairs named in ``cuts`` (``key``, zh_a, zh_b, en_a, en_b; all solid, else the cut is ignored) become two edited
    pairs with the block, page and confidence of the old one; ``seq`` is renumbered."""
    fine = cuts.where(~X.any_of([X.is_blank(F.col(c)) for c in ("zh_a", "zh_b", "en_a", "en_b")]))
    joined = pairs.join(fine, key, "left")
    cut = F.col("zh_a").isNotNull()
    half = lambda s, i: F.struct(F.lit(i).alias("i"), F.col(f"zh_{s}").alias("zh"), F.col(f"en_{s}").alias("en"))
    parts = F.when(cut, F.array(half("a", 0), half("b", 1))).otherwise(F.array(F.struct(F.lit(0).alias("i"), "zh", "en")))
    rows = joined.withColumn("_cut", cut).withColumn("_part", F.explode(parts))
    rows = rows.withColumns({
        "zh": F.col("_part.zh"), "en": F.col("_part.en"),
        key: F.when(F.col("_cut"), new_key(F.col(key), F.col("_part.i"))).otherwise(F.col(key)),
        "how": F.when(F.col("_cut"), "merged").otherwise(F.col("how")), "manually_edited": F.col("_cut") | F.col("manually_edited"),
    })
    return renumber(rows.withColumn("_i", F.col("_part.i")), piece, ["seq", "_i"]).select(*pairs.columns)


def merge_pairs(pairs: DataFrame, merges: DataFrame, piece: str, key: str = "pair_key") -> DataFrame:
    """Each pair named in ``merges`` (``key``, no two neighbours) and the next one of its piece become one edited pair: zh
    joined, en joined by a space, the lower confidence, review if either, the first block there is."""
    by = Window.partitionBy(piece).orderBy("seq")
    marked = pairs.join(merges.select(key, F.lit(True).alias("_head")).distinct(), key, "left").withColumn("_head", F.coalesce("_head", F.lit(False)))
    other = {c: F.lead(c).over(by).alias(f"_{c}") for c in (key, "seq", "zh", "en", "needs_review", "confidence", "block_no")}
    seen = marked.select("*", *other.values(), F.lag("_head").over(by).alias("_tail"), F.lag("seq").over(by).alias("_before"))
    joins = F.col("_head") & (F.col("_seq") - F.col("seq") == 1)
    zh, en = X.strip(F.concat("zh", "_zh")), X.strip(F.concat("en", F.lit(" "), "_en"))
    joins = joins & (zh != "") & (en != "")
    # The tail goes if its head took it.
    took = F.lag(joins).over(by)
    rows = seen.withColumn("_joins", F.coalesce(joins, F.lit(False))).withColumn("_gone", F.coalesce(took, F.lit(False))).where("not _gone")
    pick = lambda a, b: F.when(F.col("_joins"), a).otherwise(b)
    rows = rows.select(
        *(c for c in pairs.columns if c not in ("zh", "en", "needs_review", "confidence", "block_no", "how", "manually_edited", key)),
        pick(zh, F.col("zh")).alias("zh"), pick(en, F.col("en")).alias("en"), pick(F.col("needs_review") | F.col("_needs_review"), F.col("needs_review")).alias("needs_review"),
        pick(F.least("confidence", "_confidence"), F.col("confidence")).alias("confidence"), pick(F.coalesce("block_no", "_block_no"), F.col("block_no")).alias("block_no"),
        pick(F.lit("merged"), F.col("how")).alias("how"), (F.col("_joins") | F.col("manually_edited")).alias("manually_edited"), pick(new_key(F.col(key), F.col(f"_{key}")), F.col(key)).alias(key),
    )
    return renumber(rows, piece, ["seq"]).select(*pairs.columns)


def progress(pieces: DataFrame, reports: DataFrame, piece: str) -> DataFrame:
    """Pieces with ``last_pos`` and ``recited`` of the latest report that isn't older than the piece; of reports of one time
    the one with the highest place, recited ones last."""
    latest = reports.groupBy(piece).agg(F.max(F.struct("client_ts", F.col("last_pos").alias("p"), F.col("recited").alias("r"))).alias("_r")).withColumn("_ts", F.col("_r.client_ts"))
    joined = pieces.join(latest, piece, "left")
    fresh = F.coalesce(F.col("_ts") >= F.col("updated_at"), F.lit(False))
    return joined.withColumns({"last_pos": F.when(fresh, F.col("_r.p")).otherwise(F.col("last_pos")), "recited": F.when(fresh, F.coalesce("_r.r", "recited")).otherwise(F.col("recited"))}).drop("_r", "_ts")


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row: check-ins of a day, settings."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def settings(puts: DataFrame, keys: list[str], order: list[str], values: list[str], name: str = "k", secret: tuple[str, ...] = ("password_hash",)) -> DataFrame:
    """The last value of each setting; puts of secret ones are refused."""
    return latest_by_key(puts.where(~F.col(name).isin(*secret)), [*keys, name], order, values)


def delete_projects(projects: DataFrame, wanted: DataFrame, jobs: DataFrame, at: str, project: str = "project_id") -> DataFrame:
    """Soft deletion: projects in ``wanted`` without an active job get ``deleted_at``."""
    active = jobs.where(F.col("status").isin("queued", "running")).select(project).distinct()
    gone = wanted.select(project).distinct().join(active, project, "left_anti").withColumn("_gone", F.lit(at).cast("timestamp_ntz"))
    return projects.join(gone, project, "left").withColumn("deleted_at", F.coalesce("deleted_at", "_gone")).drop("_gone")


def restore_projects(projects: DataFrame, wanted: DataFrame, project: str = "project_id") -> DataFrame:
    back = wanted.select(project, F.lit(True).alias("_back")).distinct()
    return projects.join(back, project, "left").withColumn("deleted_at", F.when(F.col("_back"), None).otherwise(F.col("deleted_at"))).drop("_back")


def get_or_create(wanted: DataFrame, rows: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """A row for each wanted key: the stored one, or one of defaults (check-ins of a day, a project's goal)."""
    joined = wanted.select(*keys).distinct().join(rows, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})
