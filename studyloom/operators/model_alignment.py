"""Alignment by a model, checked against the alignment by balanced lengths.

Pieces are cut into blocks of numbered sentences, one row a block, and a model is asked which numbers belong together. The
provider is the caller's own: a function that runs on executors, in Arrow batches. Answers are read as VARIANT by
columns alone; a wrong answer, or an error that may pass, is asked again with what was wrong, and only those blocks are.
Each round of answers is written before it is read, so no question is put twice when a stage runs again.

A piece whose blocks are all mapped gets the model's groups; how far its cuts agree with the balanced alignment decides
the confidence of all its pairs. Any other piece gets the balanced pairs. Blocks travel as numbers and groups;
the sentences stay with their piece.

Defined results: blank sentences take no part; a piece with one empty side is never asked about and gives no pairs; an
answer of null is no JSON; an object that names a key twice is no JSON.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import stored
from . import alignment as A

# Errors of a provider that may pass, and how often a block is asked again.
TRANSIENT, RETRIES = ("rate_limited", "provider_error", "network"), 1
# Names of the two sides in an answer.
NAMES = {"zh": ("zh", "zh_indices", "zh_idx"), "en": ("en", "en_indices", "en_idx")}


class ModelError(Exception):
    """A provider's failure: its kind (``rate_limited``, ``network``, ``auth``, ...) and words about it."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}")
        self.kind, self.detail = kind, detail


#: From the texts of a conversation to the answer and the tokens of both; raises ModelError.
Provider = Callable[[list[str]], tuple[str, int, int]]


def blocks(pieces: DataFrame, keys: list[str], zh: str = "zh", en: str = "en", size: int = A.CHUNK) -> DataFrame:
    """A row for each block: ``keys``, ``block``, the places of its first sentences, ``n_zh``, ``n_en`` and ``prompt``. Both sides are cut
    into the same number of even blocks."""
    k = A.chunk_count(F.size(zh), F.size(en), size)
    cut = pieces.select(*keys, zh, en, F.posexplode_outer(F.arrays_zip(A.even_chunks(F.size(zh), k).alias("z"), A.even_chunks(F.size(en), k).alias("e"))).alias("block", "c")).where("block is not null")
    own = lambda side, c: F.slice(side, F.col(f"c.{c}.offset") + 1, F.col(f"c.{c}.take"))
    return cut.select(
        *keys, "block", F.col("c.z.offset").alias("zh_at"), F.col("c.e.offset").alias("en_at"), F.col("c.z.take").alias("n_zh"), F.col("c.e.take").alias("n_en"),
        A.prompt(own(zh, "z"), own(en, "e"), F.col("block") + 1).alias("prompt"),
    )


def _json_of(answer: Column) -> Column:
    """The JSON in an answer: what a fence holds, or all; from the first bracket to the last if it doesn't begin with one."""
    fence = r"(?s)```(?:json)?[" + X.SPACE + "]*(.*?)[" + X.SPACE + "]*```"

    def inside(body: Column) -> Column:
        first, last = F.instr(body, "["), F.length(body) - F.instr(F.reverse(body), "]") + 1
        inner = F.when((first > 0) & (F.instr(body, "]") > 0) & (last > first), F.substring(body, first, last - first + 1))
        return F.when(F.startswith(body, F.lit("[")), body).otherwise(inner)

    fenced = F.contains(answer, F.lit("```")) & answer.rlike(fence)
    return X.named(X.strip(F.when(fenced, F.regexp_extract(answer, fence, 1)).otherwise(answer)), inside)


def _places(v: Column) -> Column:
    """A side as sorted places from 0: a list, or one whole number, of numbers from 1; anything else, alone or in the list, is a null at its
    end."""
    several = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: X.as_number(x) - 1)
    return F.array_sort(F.coalesce(several, F.array(X.whole_number(v) - 1)))


def _values(x: Column) -> Column:
    """struct<zh, en> of an item and the list it may be: an object with one of the known names, or a list of two."""
    side = lambda i, names: F.when(F.size(x["pair"]) == 2, F.get(x["pair"], i)).otherwise(F.coalesce(*(F.try_variant_get(x["item"], f"$.{n}", "variant") for n in names)))
    return F.struct(*(side(i, names).alias(s) for i, (s, names) in enumerate(NAMES.items())))


def _sides(items: Column) -> Column:
    """The places of both sides of each item. One list is made after the other, as a value that is named within another is typed anew at
    each use."""
    pairs = F.transform(items, lambda item: F.struct(item.alias("item"), F.try_variant_get(item, "$", "array<variant>").alias("pair")))
    return F.transform(F.transform(pairs, _values), lambda v: F.struct(*(_places(v[s]).alias(s) for s in NAMES)))


def read_mappings(answers: DataFrame, answer: str = "answer", n_zh: str = "n_zh", n_en: str = "n_en") -> DataFrame:
    """``answers`` with ``error`` and ``groups``. Every sentence of both sides is in exactly one group; groups are in order, without gaps
    and of four at most. The first item that is wrong names the error; half a mapping is none."""
    items = F.try_variant_get(X.whole_json(_json_of(F.coalesce(answer, F.lit("")))), "$", "array<variant>")
    read = answers.withColumn("_sides", _sides(items))
    span = lambda side: F.when((F.size(side) > 0) & F.get(side, F.size(side) - 1).isNotNull(), F.struct(F.get(side, 0).alias("f"), (F.get(side, F.size(side) - 1) + 1).alias("t"), F.size(side).alias("n"), (F.size(F.array_distinct(side)) == F.size(side)).alias("once")))
    # Most answers are right: their places are all numbers in order, in groups that aren't empty or too large. Only the others are searched for
    # what is wrong.
    every = lambda s, n: (F.col(n) > 0) & (F.flatten(F.col(f"_sides.{s}")) == F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)).cast("long") - 1))
    fits = F.forall("_sides", lambda x: F.size(x["zh"]).between(1, A.MAX_GROUP) & F.size(x["en"]).between(1, A.MAX_GROUP))
    read = read.withColumn("_right", F.coalesce(fits & every("zh", n_zh) & every("en", n_en), F.lit(False)))
    read = read.withColumn("_spans", F.when(~F.col("_right"), F.transform("_sides", lambda x: F.struct(span(x["zh"]).alias("zh"), span(x["en"]).alias("en")))))

    def wrong(x: Column, i: Column) -> Column:
        before = F.get("_spans", i - 1)
        either = lambda test: test("zh", F.col(n_zh)) | test("en", F.col(n_en))
        return (
            F.when(either(lambda s, _: x[s].isNull()), "llm_bad_shape")
            .when(either(lambda s, n: (x[s]["f"] < 0) | (x[s]["t"] > n)), "llm_out_of_range")
            .when((i > 0) & either(lambda s, _: x[s]["f"] < before[s]["t"]), "llm_not_monotonic")
            .when(either(lambda s, _: ~x[s]["once"] | (x[s]["t"] - x[s]["f"] != x[s]["n"])), "llm_not_contiguous")
            .when(either(lambda s, _: x[s]["n"] > A.MAX_GROUP), "llm_oversize")
        )

    total = lambda s: F.aggregate("_spans", F.lit(0), lambda a, x: a + x[s]["n"])
    read = read.withColumn("_wrong", F.get(F.filter(F.transform("_spans", wrong), lambda e: e.isNotNull()), 0))
    error = (
        F.when(F.col("_right"), None).when(F.col("_sides").isNull(), "llm_bad_json").when(F.col("_wrong").isNotNull(), F.col("_wrong")).when(F.size("_sides") == 0, "llm_empty")
        .when((total("zh") != F.col(n_zh)) | (total("en") != F.col(n_en)), "llm_incomplete")
    )
    ends = lambda side: ((F.get(side, 0), "f"), (F.get(side, F.size(side) - 1) + 1, "t"))
    groups = F.transform("_sides", lambda x: F.struct(*(place.cast("int").alias(f"{s[0]}{e}") for s in ("zh", "en") for place, e in ends(x[s]))))
    read = read.withColumn("error", error)
    return read.withColumn("groups", F.when(F.col("error").isNull(), groups)).drop("_sides", "_right", "_spans", "_wrong")


def ask(asked: DataFrame, keys: list[str], provider: Provider, system: str = "", retries: int = RETRIES) -> DataFrame:
    """What the model maps each block to: ``keys``, ``block``, ``zh_at``, ``en_at``, ``groups``, ``error`` (null: mapped), ``attempts``, ``prompt_tokens``
    and ``completion_tokens`` of all attempts. After an error that may pass and after a wrong answer a block is asked again, with
    the error; other errors of the provider end it."""
    own = [*keys, "block", "zh_at", "en_at", "n_zh", "n_en", "prompt"]
    waiting = asked.select(*own, F.lit("").alias("last"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))
    none = F.lit(None).cast("string")
    schema = waiting.select(*own, "attempts", "prompt_tokens", "completion_tokens", none.alias("answer"), none.alias("failed"), none.alias("detail")).schema

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for text, last in zip(batch.column("prompt").to_pylist(), batch.column("last").to_pylist(), strict=True):
                try:
                    told.append((*provider([system, text, *([f"上次的回答无效：{last}。请只给出 JSON 数组。"] if last else [])]), None, None))
                except ModelError as e:
                    told.append((None, 0, 0, e.kind, e.detail))
            answer, p, c, failed, detail = zip(*told, strict=True) if told else ((),) * 5
            more = {"attempts": pa.scalar(1, pa.int32()), "prompt_tokens": pa.array(p, pa.int64()), "completion_tokens": pa.array(c, pa.int64())}
            columns = {n: batch.column(n) for n in own} | {n: pc.add(batch.column(n), x) for n, x in more.items()}
            columns |= {n: pa.array(x, pa.string()) for n, x in (("answer", answer), ("failed", failed), ("detail", detail))}
            yield pa.RecordBatch.from_pydict(columns)

    settled = None
    for attempt in range(retries + 1):
        told = stored(waiting.mapInArrow(put, schema), "answers")
        read = read_mappings(told).withColumns({"error": F.coalesce("failed", "error"), "groups": F.when(F.col("failed").isNull(), F.col("groups"))})
        again = F.lit(attempt < retries) & F.when(F.col("failed").isNull(), F.col("error").isNotNull()).otherwise(F.col("failed").isin(*TRANSIENT))
        read = stored(read.withColumn("again", again), "mappings")
        done = read.where("not again").select(*keys, "block", "zh_at", "en_at", "groups", "error", "attempts", "prompt_tokens", "completion_tokens")
        settled = done if settled is None else settled.unionByName(done)
        last = F.concat_ws(": ", "error", F.when(F.col("detail") != "", F.col("detail")))
        waiting = read.where("again").select(*own, last.alias("last"), "attempts", "prompt_tokens", "completion_tokens")
    return settled


def stitched(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each piece: its groups over all blocks, or the ``error`` of its first block that has one; and the tokens."""
    shifted = F.transform("groups", lambda g: F.struct(*((g[f"{s[0]}{e}"] + F.col(f"{s}_at")).cast("int").alias(f"{s[0]}{e}") for s in ("zh", "en") for e in ("f", "t"))))
    by = mapped.select(*keys, "block", "error", "attempts", "prompt_tokens", "completion_tokens", shifted.alias("g")).groupBy(*keys)
    whole = by.agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("block"))).alias("error"),
        F.flatten(F.array_sort(F.collect_list(F.struct("block", "g")))["g"]).alias("groups"),
        *(F.sum(c).cast("long").alias(c) for c in ("attempts", "prompt_tokens", "completion_tokens")),
    )
    return whole.withColumn("groups", F.when(F.col("error").isNull(), F.col("groups")))


def _cuts(groups: Column, zh: str) -> Column:
    """Running counts of Chinese sentences after each group; a piece without groups is one."""
    text = lambda g: F.array_join(F.slice(zh, g["zf"] + 1, g["zt"] - g["zf"]), "")
    each = F.when(F.size(groups) > 0, F.transform(F.transform(groups, text), X.count_sentences)).otherwise(F.array(X.count_sentences(F.array_join(zh, " "))))
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("n"))
    return F.aggregate(each, start, lambda a, x: F.struct(F.concat(a["cuts"], F.array(a["n"] + x)).alias("cuts"), (a["n"] + x).alias("n")), lambda a: a["cuts"])


def pairs(pieces: DataFrame, keys: list[str], provider: Provider, system: str = "", retries: int = RETRIES, zh: str = "zh", en: str = "en", size: int = A.CHUNK, floor: float = A.AGREEMENT_FLOOR) -> DataFrame:
    """Flagged pairs of every piece with ``agreement`` (null: balanced) and ``error`` (why the model's mapping wasn't taken).

    Pairs by the model have ``how`` = ``llm`` and the confidence that the agreement of both alignments gives; at the floor or
    above, flags by length alone are taken back, below it all pairs need review."""
    # Written once, as blocks and pairs are made of it.
    solid = stored(A.solid_sides(pieces, zh, en).select(*keys, zh, en, A.balanced_groups(zh, en).alias("_balanced")), "pieces")
    told = stitched(ask(blocks(solid, keys, zh, en, size), keys, provider, system, retries), keys)
    # Never broadcast: pieces and answers grow with the input, and their files are many times smaller than their rows.
    both = solid.join(told.select(*keys, "error", F.col("groups").alias("_told")).hint("merge"), keys)
    met = lambda c: 2 * F.size(F.array_intersect(c["a"], c["b"])) / (F.size(c["a"]) + F.size(c["b"]))
    agreement = X.named(F.struct(_cuts(F.col("_told"), zh).alias("a"), _cuts(F.col("_balanced"), zh).alias("b")), met)
    # The same groups have the same cuts.
    agreement = F.when(F.col("error").isNull(), F.when(F.col("_told") == F.col("_balanced"), 1.0).otherwise(agreement))
    both = both.select(*keys, zh, en, "error", F.coalesce("_told", "_balanced").alias("_g"), X.once(agreement).alias("agreement"))
    made = A.pairs_of(both, [*keys, "error", "agreement"], zh, en, ratio="_ratio")
    by_model = F.col("agreement").isNotNull()
    made = made.withColumns({"how": F.when(by_model, "llm").otherwise(F.col("how")), "confidence": F.when(by_model, 0.0).otherwise(F.col("confidence"))})
    return _agreed(A.flag(made, keys, balanced=~by_model, ratio="_ratio"), floor)


def _agreed(flagged: DataFrame, floor: float) -> DataFrame:
    """Confidence by agreement, and what follows for the flags."""
    rated = F.col("agreement").isNotNull() & ~F.coalesce(F.col("flagged_by") == "empty", F.lit(False))
    # Half-even rounding of the third digit.
    rows = flagged.withColumn("confidence", F.when(rated, F.bround(A.agreement_confidence(F.col("agreement"), floor), 3)).otherwise(F.col("confidence")))
    low = rated & (F.col("confidence") < A.LOW_CONFIDENCE)
    pardoned = rated & (F.col("agreement") >= floor) & (F.col("flagged_by") == "length_ratio")
    rows = rows.withColumn("flagged_by", F.when(~F.coalesce(pardoned, F.lit(False)), F.coalesce("flagged_by", F.when(low, "agreement"))))
    return rows.withColumn("needs_review", F.col("flagged_by").isNotNull())
