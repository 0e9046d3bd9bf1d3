"""The registered queries of the corpus operators, and their SQL where SQL can express them.

Every query applies its operator with production settings to the whole of its tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table as _table
from . import bitpack, bpe_counts, decontam, hard_negatives, hilbert, hosts, media, oracles, packing, quality_rules, simhash, spelling, substring_dedup, toxicity
from .common import bounded, shared_path

WORD_TOKENIZER, BYTE_TOKENIZER, END_ID = "word_bpe_49k.json", "byte_bpe_50k.json", 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return _table(spark, sf_dir, name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    # Spans are flattened: ends count up, starts down.
    n_hit = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    counted = hits.withColumn("n_hit", n_hit)
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", "item_ids"), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return media.described(stored, ["doc_id", "n_bytes"])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe_counts.with_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), keep=["doc_id"])
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    weights = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(documents, weights, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.read_files(bitpack.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the strings of 400 bytes, the words in repeated passages of over 50 words, which may be shorter."""
    found = substring_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return substring_dedup.digest_kept(found, ["doc_id"])


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shard files and reads places, sizes and check sums back from them."""
    stored = hilbert.write_shards(hilbert.shard_documents(table(spark, sf_dir, "documents")), shared_path(spark, "shards"))
    body = F.coalesce("row.text", F.lit(""))
    return stored.select(
        "row.doc_id",
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit(hilbert.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the rows of labels whose id is the page's; bad is low quality or toxic."""
    judged = hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), misspelt_every=spelling.MISSPELT_EVERY)
    return spelling.variants(counts).select("word", "n", "n_near", "form", "form_n", "root")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id are shifted; anchors are the ids divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    shifted = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    mined = hard_negatives.mine(shifted, F.col("id") % 100 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_simhash, op3_audio_features, op4_token_counts, op5_toxicity, op6_bit_packing, op7_substring_dedup, op8_hilbert_shards, op9_host_reputation, op10_packing, op11_spelling_variants, op12_quality_rules, op13_hard_negatives)}
ORACLES: dict[str, str] = {
    "op9_host_reputation": hosts.SQL,
    "op11_spelling_variants": oracles.SPELLING,
    "op12_quality_rules": oracles.QUALITY,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
