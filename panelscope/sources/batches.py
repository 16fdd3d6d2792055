"""Epochs of training batches from category folders.

The files below ``root/<class>/`` are listed, decoded once and brought to one
size and channel count; the result is a table. An epoch is a seeded permutation
of the narrow path table; rows of ``batch_size`` neighbours meet their pixels in
one task, which makes one block of them: a tensor and one-hot labels. So an
epoch moves each image once and decodes none."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.operators.images import random_augment, resize, to_bgr, to_gray
from panelscope.operators.ranking import hash_order_key, range_rank
from panelscope.session import written
from panelscope.sources.files import list_images, parent_dir, read_pixels

BLOCK = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("names", T.ArrayType(T.StringType())),
    T.StructField("x", T.BinaryType()),
    T.StructField("y", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


def tensor(x: bytes, n: int, size: tuple[int, int], channels: int) -> np.ndarray:
    """A block's pixels as an (n, h, w, c) array of 32-bit floats."""
    return np.frombuffer(x, np.float32).reshape(n, *size, channels)


@dataclass
class FolderBatches:
    """``images``: name (``<class>/<file>``), label, SAMPLE of one shape; ``counts`` of decoded and failed files."""

    images: DataFrame
    classes: list[str]
    size: tuple[int, int]
    channels: int
    counts: dict[str, int]

    def epoch(self, number: int = 0, seed: int = 0, batch_size: int = 32, shuffle: bool = True, rescale: float = 1.0 / 255, augment: bool = False) -> DataFrame:
        """The blocks of an epoch: ``batch_id`` from 0, ``n`` images (the last
        batch may have fewer), their ``names``, the pixels times ``rescale``
        (row-major (n, h, w, c), 32-bit floats: see ``tensor``) and one-hot labels.

        Each file is in one batch. The order depends on seed, epoch and names
        alone (by name without ``shuffle``). ``augment`` warps each image at random, in another way each epoch."""
        order = [hash_order_key(f"{seed}:{number}:", "name"), "name"] if shuffle else ["name"]
        place = range_rank(self.images.select("name"), order, "_place")
        rows = self.images.join(place, "name")
        if augment:
            rows = random_augment(rows, "name", F.lit(number), seed)
        n_classes = len(self.classes)

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches).sort_by("_place")
            data = b"".join(t["SAMPLE"].combine_chunks().field("data").to_pylist())
            x = (np.frombuffer(data, np.uint8).astype(np.float32) * np.float32(rescale)).tobytes()
            y = np.eye(n_classes, dtype=np.int32)[t["label"].to_numpy()].tolist()
            yield pa.RecordBatch.from_pylist([{"epoch": number, "batch_id": t["batch_id"][0].as_py(), "n": t.num_rows, "names": t["name"].to_pylist(), "x": x, "y": y}], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(BLOCK)
        keyed = rows.withColumn("batch_id", F.floor((F.col("_place") - 1) / F.lit(batch_size)).cast("bigint"))
        # a group has batch_size images
        return keyed.select("batch_id", "_place", "name", "label", "SAMPLE").groupBy("batch_id").applyInArrow(block, BLOCK)


def folder_batches(
    spark: SparkSession,
    root: str,
    classes: Sequence[str] | None = None,
    size: tuple[int, int] = (128, 128),
    channels: int = 3,
    unreadable: str = "error",
) -> FolderBatches:
    """The images under ``root/<class>/`` for training: resized to ``size``
    (rows, columns), with 3 channels (BGR) or 1 (gray).

    ``classes`` gives the labels' order, and files of other folders take no
    part; by default all folder names, sorted. Files that don't decode are a
    ``ValueError``, or left out (and counted) with ``unreadable="skip"``."""
    if channels not in (1, 3):
        raise ValueError("channels is 1 or 3")
    if unreadable not in ("error", "skip"):
        raise ValueError("unreadable is error or skip")
    folder = parent_dir("SAMPLE_PATH")
    listed = list_images(spark, root).select("SAMPLE_PATH", folder.alias("class_name"), F.concat(folder, F.lit("/"), "LABEL_SAMPLE_ID").alias("name"))
    if classes is None:
        classes = [r[0] for r in listed.select("class_name").distinct().orderBy("class_name").collect()]  # as many as there are folders
    index = F.array_position(F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<string>"), F.col("class_name")) - 1
    rows = listed.withColumn("label", index.cast("int")).where("label >= 0")
    counts: dict[str, int] = {}
    read = read_pixels(rows.select("SAMPLE_PATH", "name", "label"), counts=counts)
    if counts["failed"] and unreadable == "error":
        some = [r[0] for r in read.where("SAMPLE is null").select("SAMPLE_PATH").limit(3).collect()]
        raise ValueError(f"{counts['failed']} file(s) do not decode, such as {', '.join(some)}.")
    shaped = resize((to_bgr if channels == 3 else to_gray)(read.where("SAMPLE is not null")), *size)
    return FolderBatches(written(shaped.select("name", "label", "SAMPLE"), "train-images"), list(classes), tuple(size), channels, counts)
