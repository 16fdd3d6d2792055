"""Concatenation and key-based set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.schema import KEY


def concat_rows(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name (missing columns filled with NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def duplicated_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """Keys occurring more than once (partial aggregation before the shuffle)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key)


def key_uniqueness(df: DataFrame, key: str = KEY) -> DataFrame:
    """Drop every row whose key occurs more than once (``keep=False``).

    Only the key column is aggregated; the rows are then anti-joined against
    the repeated keys. A hot key is split by AQE's skew-join handling, and the
    repeated-key side is broadcast by AQE only when its measured size is small."""
    return df.join(duplicated_keys(df, key), key, "left_anti")


def except_by_key(full: DataFrame, part: DataFrame, key: str = KEY) -> DataFrame:
    """``concat([full, part]).drop_duplicates(subset=key, keep=False)``:
    rows whose key occurs exactly once in the concatenation."""
    return key_uniqueness(concat_rows(full, part.select(*full.columns)), key)
