"""Frames shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.functions.util import as_col
from panelscope.operators.augment import ArrayImage
from panelscope.operators.joins import merge_labels_samples
from panelscope.sources.tables import document_samples, image_samples, label_frame, table

# the embedding images have one channel: known at plan time
IMG = ArrayImage("SAMPLE", "SAMPLE_H", "SAMPLE_W", 1)


def px_digest(arr) -> Column:
    """Order-sensitive checksum of an image array: sum of (k+1) * px[k] in
    index order, as double, rounded to 6 decimals."""
    weighted = F.transform(as_col(arr), lambda x, i: x.cast("double") * (i + 1).cast("double"))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x), 6)


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return merge_labels_samples(label_frame(spark, sf), document_samples(spark, sf), check="pairs")


def image_out(df: DataFrame, extra=()) -> DataFrame:
    """Image rows in a checkable shape: key, metadata as int/double, digest."""
    return df.select(
        "LABEL_SAMPLE_ID",
        F.col("MIRROR_AXIS").cast("int").alias("MIRROR_AXIS"),
        F.col("ROT_DEG").cast("int").alias("ROT_DEG"),
        F.col("TRANSL_X").cast("double").alias("TRANSL_X"),
        F.col("TRANSL_Y").cast("double").alias("TRANSL_Y"),
        *extra,
        px_digest("SAMPLE").alias("px_digest"),
    )


__all__ = ["IMG", "px_digest", "merged", "image_out", "label_frame", "document_samples", "image_samples", "table"]
