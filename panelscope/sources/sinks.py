"""Sinks: image export, category layout, array datasets."""

from __future__ import annotations

import struct
import warnings
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.schema import KEY


def _mkdirs(spark: SparkSession, path: str) -> None:
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    jp.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jp)


def write_array_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Features (array columns) and labels as Parquet (replaces pickles)."""
    df.write.mode(mode).parquet(path)


def png_bytes(arr) -> bytes:
    """Encode an (h, w, c) uint8 BGR/gray array as PNG with zlib only."""
    a = np.asarray(arr, dtype=np.uint8)
    if a.ndim == 2:
        a = a[..., None]
    h, w, c = a.shape
    if c == 3:
        a = a[..., ::-1]  # BGR -> RGB
    elif c == 4:
        a = a[..., [2, 1, 0, 3]]
    color = {1: 0, 3: 2, 4: 6}[c]
    raw = b"".join(b"\x00" + a[r].tobytes() for r in range(h))

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def _png(img: pd.DataFrame) -> pd.Series:
    def encoded(h, w, c, d):
        return png_bytes(np.frombuffer(d, dtype=np.uint8).reshape(int(h), int(w), int(c))) if isinstance(d, (bytes, bytearray)) else None

    return pd.Series([encoded(*r) for r in zip(img["height"], img["width"], img["nChannels"], img["data"])], dtype=object)


#: Bytes that must stay free on the target's file system.
MIN_FREE_BYTES = 500_000_000


def write_files(files: DataFrame, target: str, mode: str = "append", existing: str = "error", min_free_bytes: int = 0) -> None:
    """Write rows (name, content) or (name, source) as files below ``target``
    (created), all or none of them: see ``sources.image_folder``. Names that repeat are refused;
    names that exist already are refused, or kept with ``existing="keep"``."""
    from panelscope.sources.image_folder import ImageFolder

    _mkdirs(files.sparkSession, target)
    files.sparkSession.dataSource.register(ImageFolder)
    files.write.format(ImageFolder.name()).mode(mode).option("existing", existing).option("minFreeBytes", str(min_free_bytes)).save(target)


def export_png(df: DataFrame, target_dir: str, col: str = "SAMPLE", key: str = KEY, **kw) -> None:
    """Write each image as the PNG file ``target_dir/<id>`` from the executors.
    Rows without an image or an id are left out; repeated ids are refused."""
    write_files(df.select(F.col(key).alias("name"), _png(F.col(col)).alias("content")), target_dir, **kw)


def save_images(df: DataFrame, target_dir: str, col: str = "SAMPLE", key: str = KEY, min_free_bytes: int = MIN_FREE_BYTES, **kw) -> None:
    """``export_png`` with a floor of free space, below which nothing is written, and a warning."""
    warnings.warn("Saving an amplified dataset can take a while and use a lot of space.", UserWarning)
    export_png(df, target_dir, col, key, min_free_bytes=min_free_bytes, **kw)


def write_category_folders(
    df: DataFrame,
    target: str,
    label_names: Sequence[str],
    category_col: str = "LABEL_CATEGORY",
    split_col: str | None = "split",
    key: str = KEY,
    col: str | None = "SAMPLE",
    path_col: str = "SAMPLE_PATH",
    **kw,
) -> None:
    """Lay image files out for a trainer: ``train|validate/<category>/<id>``, or
    ``<category>/<id>`` without ``split_col``; a folder per label, even when empty.

    The rows that are not in the train part are the validation part. With ``col`` the
    images are written as PNG, without it the files at ``path_col`` are copied. Rows without a category fail the write."""
    part = F.when(F.col(split_col) == "train", "train").otherwise("validate") if split_col else None
    category = F.coalesce(F.col(category_col).cast("string"), F.raise_error(F.lit("a row without a category has no folder")).cast("string"))
    name = F.concat_ws("/", *([part] if split_col else []), category, F.col(key))
    what = _png(F.col(col)).alias("content") if col else F.col(path_col).alias("source")
    write_files(df.where(F.col(key).isNotNull()).select(name.alias("name"), what), target, **kw)
    for folder in ("train/", "validate/") if split_col else ("",):
        for label in label_names:
            _mkdirs(df.sparkSession, f"{target.rstrip('/')}/{folder}{label}")


def write_by_category(
    df: DataFrame,
    target: str,
    label_names: Sequence[str],
    category_col: str = "LABEL_CATEGORY",
    split_col: str | None = "split",
    key: str = KEY,
    keep_existing: bool = False,
) -> None:
    """Lay samples out by (split and) category: Parquet partitioned by
    ``split_col`` and ``category_col``; a folder per label, even when empty.
    ``keep_existing`` keeps rows already written (anti-join on the key, append)."""
    spark = df.sparkSession
    parts = [c for c in (split_col, category_col) if c]
    out = df
    if keep_existing:
        folder = spark._jvm.org.apache.hadoop.fs.Path(target)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            out = df.join(spark.read.parquet(target).select(key), key, "left_anti")
    out.write.mode("append" if keep_existing else "overwrite").partitionBy(*parts).parquet(target)
    splits = [r[0] for r in df.select(split_col).distinct().collect()] if split_col else [None]
    for s in splits:
        for lbl in label_names:
            sub = f"{split_col}={s}/{category_col}={lbl}" if split_col else f"{category_col}={lbl}"
            _mkdirs(spark, f"{target.rstrip('/')}/{sub}")
