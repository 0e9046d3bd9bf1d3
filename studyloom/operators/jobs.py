"""Accounts of batch jobs: prices, costs, progress, budget stops, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Price of unknown providers (of a million tokens in and out), and the share of the estimate that stops a job.
FALLBACK_PRICE, OVERRUN, CALL_TOKENS = (5.0, 20.0), 1.5, 1000
#: Statuses that a job can be cancelled or resumed from.
CANCELLABLE, RESUMABLE = ("queued", "running", "interrupted"), ("failed", "cancelled", "interrupted")
JOB_OF_PROJECT = {"recite": "recite_align", "graph": "graph_extract"}


def with_prices(rows: DataFrame, prices: list[tuple[str, str, float, float]], overrides: dict[tuple[str, str], tuple[float, float]] | None = None, provider: str = "provider", model: str = "model") -> DataFrame:
    """``price_in`` and ``price_out`` of a million tokens: an override, the model's price, the provider's lowest, or the
    fallback. The price list is a user's short table and becomes a map literal."""
    exact = {(p, m): (a, b) for p, m, a, b in prices} | (overrides or {})
    lowest: dict[str, tuple[float, float]] = {}
    for p, _, a, b in prices:
        lowest[p] = min(lowest.get(p, (a, b)), (a, b))
    pair = lambda v: F.struct(F.lit(float(v[0])).alias("i"), F.lit(float(v[1])).alias("o"))
    none = F.lit(None).cast("struct<i:double,o:double>")
    table = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), pair(v)))) if d else None
    by_model, by_provider = table({f"{p}\n{m}": v for (p, m), v in exact.items()}), table(lowest)
    found = F.coalesce(
        by_model[F.concat(F.col(provider), F.lit("\n"), F.col(model))] if by_model is not None else none,
        by_provider[F.col(provider)] if by_provider is not None else none,
        pair(FALLBACK_PRICE),
    )
    return rows.withColumn("_price", found).withColumns({"price_in": F.col("_price.i"), "price_out": F.col("_price.o")}).drop("_price")


def cost(prompt: Column, completion: Column) -> Column:
    return prompt / 1_000_000 * F.col("price_in") + completion / 1_000_000 * F.col("price_out")


def ledger(usages: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Tokens and costs of each (provider, model) of each key; calls without tokens or a model aren't counted. Each call's
    cost is rounded before it is added up, as decimals, so sums don't depend on their order."""
    used = usages.where("provider <> '' and model <> '' and prompt_tokens + completion_tokens > 0")
    money = lambda tokens, price: F.sum(F.round(F.col(tokens) / 1_000_000 * F.col(price), digits).cast(f"decimal(20,{digits})")).cast("double")
    return used.groupBy(*keys, "provider", "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), money("prompt_tokens", "price_in").alias("prompt_cost"), money("completion_tokens", "price_out").alias("completion_cost"))


def unit_key(index: Column, title: Column) -> Column:
    """``0007:title``: four digits at least, all of them where there are more."""
    return F.format_string("%04d:%s", index.cast("long"), title)


def absorb(outcomes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state of each unit: done if any outcome was created, replaced or skipped, else failed, with the last outcome."""
    done = F.bool_or(F.col("outcome").isin("created", "replaced", "skipped"))
    return outcomes.groupBy(*keys).agg(F.when(done, "done").otherwise("failed").alias("state"), F.max_by("outcome", F.struct(*order)).alias("outcome"), F.count("*").alias("attempts"))


def progress(units: DataFrame, states: DataFrame, job: str, unit: str) -> DataFrame:
    """``total``, ``done``, ``failed`` and ``progress`` (whole percent) of each job."""
    joined = units.join(states.select(job, unit, "state"), [job, unit], "left")
    done, failed = F.count_if(F.col("state") == "done"), F.count_if(F.col("state") == "failed")
    return joined.groupBy(job).agg(F.count("*").alias("total"), done.alias("done"), failed.alias("failed"), F.floor((done + failed) * 100 / F.count("*")).cast("int").alias("progress"))


def pending(units: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Units that a resumed job still has to do: all that aren't done."""
    return units.join(states.where("state = 'done'").select(*keys), keys, "left_anti")


def resumed_status(units: DataFrame, prior: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """``status`` of each unit at a resume: the prior one where the unit is settled, else pending."""
    joined = units.join(prior.select(*keys, F.col("status").alias("_prior")), keys, "left").join(states.select(*keys, "state"), keys, "left")
    return joined.withColumn("status", F.when(F.col("state").isNotNull() & F.col("_prior").isNotNull(), F.col("_prior")).otherwise("pending")).drop("_prior", "state")


def migrated(done: DataFrame, units: DataFrame, job: str, key: str = "unit_key", title: str = "title") -> DataFrame:
    """Done marks by title become keys where just one unit has the title; others stay as they are."""
    single = units.groupBy(job, title).agg(F.count("*").alias("_n"), F.min(key).alias("_key")).where("_n = 1").select(job, F.col(title).alias("_title"), "_key")
    joined = done.join(single, (done[job] == single[job]) & (done[key] == F.col("_title")) & ~F.contains(done[key], F.lit(":")), "left")
    return joined.select(*(done[c] for c in done.columns if c != key), F.coalesce("_key", done[key]).alias(key)).distinct()


def migrated_failures(failures: DataFrame, done: DataFrame, units: DataFrame, job: str, key: str = "unit_key", title: str = "title", place: str = "place") -> DataFrame:
    """Failures at a resume: those without a key get that of the one unit with their title, or go where no unit or several
    have it; those of units that are done go; of a unit's several failures, old and new, the last (``place``) stays, so that resuming
    again and again doesn't add up copies."""
    single = units.groupBy(job, title).agg(F.count("*").alias("_n"), F.min(key).alias("_key")).where("_n = 1").select(job, title, "_key")
    known = failures.join(single, [job, title], "left").withColumn(key, F.coalesce(F.nullif(key, F.lit("")), "_key")).drop("_key").where(F.col(key).isNotNull())
    left = known.join(migrated(done, units, job, key, title).select(job, key), [job, key], "left_anti")
    last = F.row_number().over(Window.partitionBy(job, key).orderBy(F.desc(place)))
    return left.withColumn("_n", last).where("_n = 1").drop("_n").select(failures.columns)


def budget_stops(costs: DataFrame, job: str, order: list[str], value: str, estimate: str, ratio: float = OVERRUN) -> DataFrame:
    """The first row of each job whose running cost is over ``ratio`` times the estimate; jobs without an estimate never
    stop. ``running``: the cost so far."""
    by = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = costs.withColumn("running", F.sum(value).over(by)).where((F.col(estimate) > 0) & (F.col("running") > ratio * F.col(estimate)))
    return over.withColumn("_n", F.row_number().over(Window.partitionBy(job).orderBy(*order))).where("_n = 1").drop("_n")


def over_budget(prompt_tokens: Column, limit: Column) -> Column:
    """Whether one call would cost more than the limit (0: none), a fixed number of answer tokens assumed."""
    return (limit > 0) & (cost(prompt_tokens, F.lit(CALL_TOKENS)) > limit)


def estimated_cost(units: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """``units``, ``prompt_tokens`` and ``cost`` of all units of a job before it runs (token and price columns), from whole sums
    of tokens by price, so the order of rows doesn't matter."""
    sums = units.groupBy(*keys, "price_in", "price_out").agg(F.count("*").alias("_n"), F.sum("prompt_tokens").alias("_p"), F.sum("completion_tokens").alias("_c"))
    money = F.sum((F.col("_p") * F.col("price_in") / 1_000_000 + F.col("_c") * F.col("price_out") / 1_000_000).cast(f"decimal(24,{digits})")).cast("double")
    return sums.groupBy(*keys).agg(F.sum("_n").alias("units"), F.sum("_p").alias("prompt_tokens"), money.alias("cost"))


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart, jobs that were queued or running are interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def transition(status: Column, action: Column) -> Column:
    """The status after cancel or resume; null where that is refused."""
    return F.when((action == "cancel") & status.isin(*CANCELLABLE), "cancelled").when((action == "resume") & status.isin(*RESUMABLE), "queued")


def finished(status: Column, done: Column, failed: Column, total: Column) -> Column:
    """Percent of a job that ended: a hundred on success."""
    return F.when(status == "success", 100).otherwise(F.floor((done + failed) * 100 / F.greatest(total, F.lit(1))).cast("int"))


def admitted(requests: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """``requests`` (``project_id``, ``file_id``, ``type``, ``has_provider``) with ``refusal`` (null: admitted)."""
    p = projects.select("project_id", F.col("type").alias("_kind"), F.col("deleted_at").alias("_gone"))
    f = files.select("file_id", F.col("project_id").alias("_owner"), F.col("deleted_at").alias("_lost"))
    joined = requests.join(p, "project_id", "left").join(f, "file_id", "left")
    want = F.create_map(*(F.lit(x) for kv in JOB_OF_PROJECT.items() for x in kv))[F.col("_kind")]
    refusal = (
        F.when(~F.col("type").isin(*JOB_OF_PROJECT.values()), "type").when(F.col("_kind").isNull() | F.col("_gone").isNotNull(), "no project").when(~want.eqNullSafe(F.col("type")), "kind")
        .when(F.col("_owner").isNull() | F.col("_lost").isNotNull(), "no file").when(F.col("_owner") != F.col("project_id"), "other project").when((F.col("type") == "graph_extract") & ~F.col("has_provider"), "no provider")
    )
    return joined.withColumn("refusal", refusal).drop("_kind", "_gone", "_owner", "_lost")


# Words by which answers of providers are told apart.
QUOTA_WORDS = ("insufficient", "quota", "exceeded", "余额", "额度", "欠费", "arrearage", "billing", "out of credit")


def error_class(status: Column, body: Column) -> Column:
    """The kind of a provider's error by status and text."""
    low = F.lower(body)
    quota = low.rlike("|".join(QUOTA_WORDS))
    denied = low.rlike("not authorized|access denied")
    return (
        F.when(status.isin(401, 403), F.when(denied, "bad_request").otherwise("key_invalid")).when(status == 429, F.when(quota, "quota_exceeded").otherwise("rate_limited"))
        .when(status == 402, "quota_exceeded").when(status.isin(400, 404, 413, 422), "bad_request").otherwise("provider_error")
    )
