"""Small tables with the awkward rows that every operator must take."""

import os

import duckdb
from pyspark.sql import types as T

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators give to their own columns.
CLASHES = ["score", "shard", "slot", "features", "n_tokens", "owner", "kept", "component_id", "n_lines", "held_out"]


def documents(spark, rows):
    """rows: (doc_id, text, ...) with lang, source and n_chars null where they are not given."""
    return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], DOCUMENT)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES))


def real_documents(sf_dir=SF_DIR):
    return duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{sf_dir}/documents.parquet'").fetchall()


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
