"""Declared schemas and the schema operators that run on DataFrames.

A schema is a plain ``StructType``; every field carries its doc string in
``metadata["doc"]`` and fields are kept in name order (the reference iterates
its schema attributes alphabetically, so projections come out sorted).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME_RE = re.compile(r"^[A-Za-z0-9_]*$")

# Spark's own image-source struct (``spark.read.format("image")``).
IMAGE_STRUCT = T.StructType(
    [
        T.StructField("origin", T.StringType(), True),
        T.StructField("height", T.IntegerType(), True),
        T.StructField("width", T.IntegerType(), True),
        T.StructField("nChannels", T.IntegerType(), True),
        T.StructField("mode", T.IntegerType(), True),
        T.StructField("data", T.BinaryType(), True),
    ]
)


def field(name: str, dtype: T.DataType, doc: str = "", nullable: bool = True) -> T.StructField:
    check_column_name(name)
    return T.StructField(name, dtype, nullable, metadata={"doc": doc})


def check_column_name(name: str) -> str:
    if not _NAME_RE.match(name):
        raise ValueError(
            f"{name!r} is no column name: ASCII letters, digits and underscores are."
        )
    return name


def make_schema(*fields: T.StructField) -> T.StructType:
    """Build a schema from fields: names checked, duplicates rejected, sorted by name."""
    seen: set[str] = set()
    for f in fields:
        check_column_name(f.name)
        if f.name in seen:
            raise ValueError(f"Duplicate column {f.name!r} in schema.")
        seen.add(f.name)
    return T.StructType(sorted(fields, key=lambda f: f.name))


def extend_schema(base: T.StructType, *fields: T.StructField) -> T.StructType:
    return make_schema(*base.fields, *fields)


# ---- declared schemas ------------------------------------------------------

KEY = "LABEL_SAMPLE_ID"

SCHEMA_DEFECT_DATA = make_schema(field(KEY, T.StringType(), "Sample identifier shared by labels and samples."))
SCHEMA_LABELS = extend_schema(
    SCHEMA_DEFECT_DATA, field("LABEL_CATEGORY", T.StringType(), "Label category (bin of the probability).")
)
SCHEMA_SAMPLES = extend_schema(
    SCHEMA_DEFECT_DATA,
    field("SAMPLE_PATH", T.StringType(), "Path of the sample file."),
    field("SAMPLE_PATH_CATEGORY", T.StringType(), "Path of the sample in its category folder."),
    field("SAMPLE", IMAGE_STRUCT, "Sample image."),
)
AMPLIFY_FIELDS = (
    field("MIRROR_AXIS", T.ShortType(), "Mirror axis 1..4 (0 = not mirrored)."),
    field("ROT_DEG", T.ShortType(), "Counter-clockwise rotation in degrees."),
    field("TRANSL_X", T.DoubleType(), "Translation along x (fraction of width, or pixels)."),
    field("TRANSL_Y", T.DoubleType(), "Translation along y (fraction of height, or pixels)."),
)
SCHEMA_SAMPLES_IMAGE = extend_schema(SCHEMA_SAMPLES, *AMPLIFY_FIELDS)
SCHEMA_LABELS_ELPV = extend_schema(
    SCHEMA_LABELS,
    field("LABEL_FILENAME", T.StringType(), "Path of the label file the row came from."),
    field("LABEL_PATH", T.StringType(), "Sample path as written in the label file (19 chars max)."),
    field("TYPE", T.StringType(), "Panel type (4 chars max)."),
    field("PROBABILITY", T.DoubleType(), "Defect probability."),
)


def merge_schemas(left: T.StructType, right: T.StructType) -> T.StructType:
    """Union of two schemas; a shared name with a different type is an error.

    Equal fields merge and the right side's doc wins.
    """
    out: dict[str, T.StructField] = {f.name: f for f in left.fields}
    for f in right.fields:
        if f.name in out and out[f.name].dataType != f.dataType:
            raise ValueError(
                f"Cannot merge schemas: column {f.name!r} is {out[f.name].dataType.simpleString()} "
                f"on the left and {f.dataType.simpleString()} on the right."
            )
        out[f.name] = f
    return make_schema(*out.values())


SCHEMA_FULL_IMAGE = merge_schemas(SCHEMA_LABELS, SCHEMA_SAMPLES_IMAGE)
SCHEMA_FULL_ELPV = merge_schemas(SCHEMA_LABELS_ELPV, SCHEMA_SAMPLES_IMAGE)


def empty_from_schema(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def check_schema(df: DataFrame | T.StructType, schema: T.StructType) -> None:
    """Raise ``ValueError`` unless every declared (name, type) is present.

    Extra columns are allowed. Column names must be ``[A-Za-z0-9_]*`` and unique.
    """
    actual = df.schema if isinstance(df, DataFrame) else df
    names = [f.name for f in actual.fields]
    for n in names:
        check_column_name(n)
    dups = sorted({n for n in names if names.count(n) > 1})
    if dups:
        raise ValueError(f"Duplicate columns: {dups}")
    have = {f.name: f.dataType for f in actual.fields}
    problems = []
    for f in schema.fields:
        if f.name not in have:
            problems.append(f"missing {f.name!r}")
        elif have[f.name] != f.dataType:
            problems.append(
                f"{f.name!r} is {have[f.name].simpleString()}, declared {f.dataType.simpleString()}"
            )
    if problems:
        raise ValueError("Schema check failed: " + "; ".join(problems))


def cast_to_schema(df: DataFrame, schema: T.StructType, keep_extra: bool = True) -> DataFrame:
    """Cast every declared column to its declared type, declared columns first in
    schema (name) order. Values that do not convert become NULL (``try_cast``);
    use :func:`cast_failures` / :func:`assert_castable` to count or refuse them.
    Declared columns missing from ``df`` are added as typed NULLs.
    """
    have = set(df.columns)
    cols: list[Column] = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(f.name)
            src = df.schema[f.name].dataType
            cols.append((c if src == f.dataType else c.try_cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    declared = {f.name for f in schema.fields}
    if keep_extra:
        cols += [F.col(c) for c in df.columns if c not in declared]
    return df.select(*cols)


def cast_failures(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One-row frame: per declared column, number of non-NULL values that do
    not convert to the declared type (one aggregate pass)."""
    aggs = []
    for f in schema.fields:
        if f.name not in df.columns or df.schema[f.name].dataType == f.dataType:
            aggs.append(F.lit(0).cast("long").alias(f.name))
            continue
        c = F.col(f.name)
        aggs.append(F.count_if(c.isNotNull() & c.try_cast(f.dataType).isNull()).alias(f.name))
    return df.agg(*aggs)


def assert_castable(df: DataFrame, schema: T.StructType) -> None:
    row = cast_failures(df, schema).first()
    bad = {k: v for k, v in row.asDict().items() if v}
    if bad:
        raise ValueError(f"Values that do not convert to the declared types: {bad}")
