"""Replay of offline writes: the last writer wins, per row, in the order of client times.

With a batch's server clock fixed, the sequential replay has a closed form: of a row's admitted writes that aren't older
than the row, the first is applied and moves the row to the server clock; a later one is applied if it isn't older than
that. So a batch is one window over each row's writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

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
BATCH, OFFSET_MS = 200, 5000


def utc(text: Column) -> Column:
    """A client's time text, with or without a zone, as naive UTC, whatever the session's time zone is: wall times never pass
    through it, as it may skip an hour or have one twice. Zones count from the moment's microseconds since 1970."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    moment = F.timestamp_add("MICROSECOND", F.unix_micros(F.try_to_timestamp(F.when(zoned, text))), F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.coalesce(moment, F.when(~zoned, text).try_cast("timestamp_ntz"))


def client_time(now: Column, offset_ms: int = OFFSET_MS) -> Column:
    return F.date_trunc("second", now + F.expr(f"interval {offset_ms} milliseconds")).cast("timestamp_ntz")


def admission(entity: Column, fields: Column, writable: dict[str, tuple[str, ...]] = WRITABLE) -> Column:
    """Null for writes of known entities and fields, else ``error``. ``fields``: array of field names."""
    allowed = None
    for name, own in writable.items():
        fine = F.size(F.array_except(fields, F.array(*map(F.lit, own)))) == 0
        allowed = F.when(entity == name, fine) if allowed is None else allowed.when(entity == name, fine)
    return F.when(F.coalesce(allowed, F.lit(False)), F.lit(None).cast("string")).otherwise("error")


def replay(ops: DataFrame, rows: DataFrame, keys: list[str], now: Column, order: list[str], refused: Column | None = None) -> DataFrame:
    """``ops`` (``client_ts``) with ``status``: error (``refused`` is not null), skipped (no such row), conflict or applied,
    and the row's ``version`` before the batch. ``rows``: ``keys`` and ``updated_at``."""
    known = rows.select(*keys, F.col("updated_at").alias("version"))
    joined = ops.join(known, keys, "left").withColumn("_refused", F.lit(None).cast("string") if refused is None else refused)
    fits = F.col("_refused").isNull() & (F.col("client_ts") >= F.col("version"))
    by = Window.partitionBy(*keys).orderBy("client_ts", *order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.col("_fits").cast("int")).over(by), F.lit(0))
    seen = joined.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_before", before)
    applied = F.col("_fits") & ((F.col("_before") == 0) | (F.col("client_ts") >= now))
    status = F.when(F.col("_refused").isNotNull(), F.col("_refused")).when(F.col("version").isNull(), "skipped").when(applied, "applied").otherwise("conflict")
    return seen.withColumn("status", status).drop("_refused", "_fits", "_before")


def foreign_category(ops: DataFrame, nodes: DataFrame, categories: DataFrame) -> DataFrame:
    """``ops`` (``entity_id``, ``category_id``) with ``refused``: error where the category isn't one of the node's project."""
    node = nodes.select(F.col("node_id").alias("entity_id"), F.col("project_id").alias("_p"))
    category = categories.select("category_id", F.col("project_id").alias("_q"))
    joined = ops.join(node, "entity_id", "left").join(category, "category_id", "left")
    return joined.withColumn("refused", F.when(F.col("_p").isNotNull() & ~F.col("_p").eqNullSafe(F.col("_q")), "error")).drop("_p", "_q")


def merged_fields(replayed: DataFrame, keys: list[str], patch: str, order: list[str]) -> DataFrame:
    """The last applied value of each field: ``keys``, ``field``, ``value``. ``patch``: map<string,string>."""
    fields = replayed.where("status = 'applied'").select(*keys, F.struct("client_ts", *order).alias("_at"), F.explode(patch).alias("field", "value"))
    return fields.groupBy(*keys, "field").agg(F.max_by("value", "_at").alias("value"))


def pages(queue: DataFrame, client: list[str], order: list[str], size: int = BATCH) -> DataFrame:
    """A client's queue in order of client times, with ``batch`` numbers from 0."""
    by = Window.partitionBy(*client).orderBy("client_ts", *order)
    return queue.withColumn("batch", F.floor((F.row_number().over(by) - 1) / size).cast("int"))


def remaining(queue: DataFrame, results: DataFrame, op: str = "op_id", failed_from: Column | None = None) -> DataFrame:
    """What stays in the queue: writes that ended as errors, and all from the first batch that couldn't be sent."""
    errors = results.where("status = 'error'").select(op).distinct()
    kept = queue.join(errors.withColumn("_e", F.lit(True)), op, "left")
    unsent = F.lit(False) if failed_from is None else F.coalesce(F.col("batch") >= failed_from, F.lit(False))
    return kept.where(F.coalesce("_e", F.lit(False)) | unsent).drop("_e")


def _last(ops: DataFrame, entity: str, order: list[str]) -> tuple[DataFrame, Column]:
    """The entity's ops as (entity_id, _v: the patch as VARIANT), and their order. Patches that aren't objects change nothing."""
    own = ops.where(F.col("entity") == entity).select("entity_id", F.struct(*order).alias("_at"), F.try_parse_json("patch").alias("_v"))
    return own.where(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT"))), F.col("_at")


def patched_pieces(pieces: DataFrame, ops: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """A client's pieces after its own writes (``entity``, ``entity_id``, ``patch``: JSON): the last number given as ``last_pos`` and the last truth value
    given as ``recited``; other types, other fields and unknown pieces change nothing."""
    own, at = _last(ops, "piece_progress", order)
    pick = lambda field, kind, types: F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.{field}", "variant")).rlike(f"^({types})"), F.try_variant_get("_v", f"$.{field}", kind))
    given = {"last_pos": pick("last_pos", "double", "BIGINT|DOUBLE|DECIMAL"), "recited": pick("recited", "boolean", "BOOLEAN")}
    last = own.groupBy("entity_id").agg(*(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_{c}") for c, v in given.items()))
    joined = pieces.join(last, pieces[key].cast("string") == last.entity_id, "left")
    kinds = dict(pieces.dtypes)
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}").cast(kinds[c]), F.col(c)) for c in given}).select(*pieces.columns)


def patched_checkins(checkins: DataFrame, ops: DataFrame, order: list[str], now: str) -> DataFrame:
    """A client's check-ins (``date``, ``items``, ``updated_at``): the last write of a day replaces its entry or adds one, with the list it gives or an empty one."""
    own, at = _last(ops, "checkin", order)
    items = F.coalesce(F.transform(F.try_variant_get("_v", "$.items_json", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))
    last = own.groupBy("entity_id").agg(F.max_by(items, at).alias("items"))
    fresh = last.select(F.col("entity_id").cast(dict(checkins.dtypes)["date"]).alias("date"), "items", F.lit(now).cast(dict(checkins.dtypes)["updated_at"]).alias("updated_at"))
    return checkins.join(fresh.select("date"), "date", "left_anti").unionByName(fresh)


def patched_plans(plans: DataFrame, ops: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """A client's plans (``key``, ``row``: all fields as a map of JSON): each field has the value of the last write that gives it, known to the server or
    not; fields that no write gives stay, unknown plans aren't added."""
    own, at = _last(ops, "plan", order)
    each = own.select("entity_id", "_at", F.explode(F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>"))).alias("f"))
    fields = each.groupBy("entity_id", F.col("f.key").alias("field")).agg(F.max_by(F.to_json("f.value"), at).alias("value"))
    patch = fields.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_patch"))
    joined = plans.join(patch, plans[key].cast("string") == patch.entity_id, "left")
    kept = F.map_filter("row", lambda k, _: ~F.map_contains_key("_patch", k))
    return joined.withColumn("row", F.when(F.col("_patch").isNull(), F.col("row")).otherwise(F.map_concat(kept, F.col("_patch")))).select(*plans.columns)
