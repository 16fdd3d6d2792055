"""Reading the parquet tables and shaping them into labelled-sample frames.

No images or label files ship with the test data, so the stand-ins are:
``labels`` -> label file lines, ``documents`` -> samples (``lang`` plays the
panel type), ``embeddings`` -> 8×8×1 images with class ``label``.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.operators.projections import base_amplify_meta
from panelscope.schema import KEY
from panelscope.sources.labels import labels_from_table, sample_id_from_int

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def label_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_from_table(table(spark, sf_dir, "labels"))


def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples from ``documents``: key, paths, amplification metadata, and the
    document's ``lang`` and ``n_chars``."""
    d = table(spark, sf_dir, "documents")
    sid = sample_id_from_int("doc_id")
    path = F.concat(F.lit("samples/"), F.col("source"), F.lit("/"), sid)
    out = d.select(
        sid.alias(KEY),
        path.alias("SAMPLE_PATH"),
        path.alias("SAMPLE_PATH_CATEGORY"),
        "lang",
        "n_chars",
    )
    return base_amplify_meta(out)


def image_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples from ``embeddings``: flat float arrays as square 1-channel images."""
    e = table(spark, sf_dir, "embeddings")
    side = F.sqrt(F.size("embedding")).cast("int")
    out = e.select(
        sample_id_from_int("vec_id").alias(KEY),
        F.col("embedding").alias("SAMPLE"),
        side.alias("SAMPLE_H"),
        side.alias("SAMPLE_W"),
        F.lit(1).alias("SAMPLE_C"),
        F.col("label").alias("CLASS"),
    )
    return base_amplify_meta(out)
