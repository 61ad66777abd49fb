"""A training corpus from ``documents``: judged, cut, thinned out, decontaminated and encoded.

Each stage takes the Parquet table that the stage before it wrote. All but the last return the columns of
``documents``, and tables with null columns, repeated rows or no rows go through as the operators'
docstrings say. Columns beyond those of ``documents`` stay too, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.bpe import decode_bpe, encode_bpe
from tallyfield.llm.jaccard import jaccard_components
from tallyfield.llm.kernel import fit_for_labels, score_texts
from tallyfield.llm.lines import drop_common_lines
from tallyfield.llm.plans import VOCABULARY, table
from tallyfield.llm.templates import decontaminate
from tallyfield.llm.text import share_package
from tallyfield.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    share_package(spark)
    model, _ = fit_for_labels(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    kept = score_texts(docs.select(rest, "text"), model).where(F.col("score") >= 0.5)
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; ``n_chars`` counts the new text."""
    share_package(spark)
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    cut = drop_common_lines(docs.select(F.col("doc_id"), "text", rest))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    return cut.select(*[
        F.col("text") if c == "text" else changed if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns
    ])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each component of similar documents stays."""
    share_package(spark)
    numbered = written(docs.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("row")), "numbered", "zstd")
    grouped = jaccard_components(numbered.select("n", F.col("row.text").alias("text")), key="n")
    first = grouped.where(F.col("n") == F.col("component_id")).select("n")
    return numbered.join(first, "n", "left_semi").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's template go."""
    share_package(spark)
    held = docs.select(F.struct("*").alias("row"), "text")
    marked = decontaminate(held, table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col("contaminated")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, and the text that they decode to."""
    share_package(spark)
    encoded = encode_bpe(docs.select("doc_id", "lang", "source", "text"), VOCABULARY).drop("text")
    return decode_bpe(encoded, VOCABULARY)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", tokens),
]

#: The classifier, the join's components and byte-pair encoding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
