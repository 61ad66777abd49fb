"""The queries of the numbered operators over the given tables, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.bpe import decode_bpe, encode_bpe
from tallyfield.llm.conversations import damage_turns, repair_conversations
from tallyfield.llm.jaccard import jaccard_components
from tallyfield.llm.kernel import quality_scores
from tallyfield.llm.lines import drop_common_lines
from tallyfield.llm.mixing import score_documents
from tallyfield.llm.pseudonyms import pseudonymise
from tallyfield.llm.repeats import remove_repeats
from tallyfield.llm.secrets import joined_spans, scan_secrets
from tallyfield.llm.shards import assign_shards
from tallyfield.llm.spelling import spelling_variants
from tallyfield.llm.templates import decontaminate
from tallyfield.llm.text import share_package
from tallyfield.llm.trees import quality_rules

#: The key of the query; a real one comes from a secret store.
KEY = "key of the query"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_sha256(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score_documents(docs, classes="lang").select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are owners; a source's documents of one language are a repository."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repository")
    )
    found = scan_secrets(docs)
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "model_score",
    )


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, KEY).select("doc_id", "n_replaced", "text")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", utf8_sha256(F.col("text")).alias("kept_sha256")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "contaminated", F.size("items").cast("long").alias("n_items"), "items")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_bpe(docs, VOCABULARY).drop("text")
    return decode_bpe(encoded, VOCABULARY).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        utf8_sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage by the contract, then repair; conversations that lost all their rows have zeros."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = repair_conversations(damage_turns(rows))
    summary, hashes = repair.summary(), repair.hashes().withColumnRenamed("conv_id", "_h")
    found = summary.withColumnRenamed("conv_id", "_c").join(hashes, F.col("_c").eqNullSafe(F.col("_h")))
    all_ids = rows.select("conv_id").distinct()
    joined = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", utf8_sha256(F.lit(""))).alias("repaired_sha256"),
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(docs, damage=True)


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_secrets": op2_secrets,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_shards": op9_shards,
    "op10_bpe": op10_bpe,
    "op11_repeats": op11_repeats,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}

_BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op7_line_dedup": rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
            FROM documents
        ), lines AS (
            SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS nr FROM docs
        ), keyed AS (
            SELECT *, translate(trim(line, {_BLANKS}),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), common AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
        ), kept AS (
            SELECT r, nr, line, key IN (SELECT key FROM common) AS gone FROM keyed
        )
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM kept JOIN docs USING (r) GROUP BY r, doc_id
    """,
}
