"""Projections and derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.schema import AMPLIFY_FIELDS, KEY, SCHEMA_LABELS_ELPV, SCHEMA_SAMPLES_IMAGE


def project_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns that ``df`` has, in schema (name) order."""
    return df.select(*[f.name for f in schema.fields if f.name in df.columns])


def project_labels(df: DataFrame, schema: T.StructType = SCHEMA_LABELS_ELPV) -> DataFrame:
    return project_schema(df, schema)


def project_samples(df: DataFrame, schema: T.StructType = SCHEMA_SAMPLES_IMAGE, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*[f.name for f in schema.fields if f.name in df.columns], *extra)


def project_images(df: DataFrame, sample_col: str = "SAMPLE") -> DataFrame:
    return df.select(sample_col)


def key_first(df: DataFrame, key: str = KEY) -> DataFrame:
    return df.select(key, *[c for c in df.columns if c != key])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns (names absent from ``df`` are ignored, like pandas)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def select_xy(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).alias("X"), F.col(y).alias("Y"))


def const_columns(df: DataFrame, values: Mapping[str, object], types: Mapping[str, T.DataType] | None = None) -> DataFrame:
    types = types or {}
    return df.withColumns({k: F.lit(v).cast(types[k]) if k in types else F.lit(v) for k, v in values.items()})


def base_amplify_meta(df: DataFrame) -> DataFrame:
    """Amplification metadata initialised to 0 (not mirrored/rotated/translated)."""
    return const_columns(df, {f.name: 0 for f in AMPLIFY_FIELDS}, {f.name: f.dataType for f in AMPLIFY_FIELDS})
