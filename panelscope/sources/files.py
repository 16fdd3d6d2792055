"""File sources: sample listings, images, CSV, array datasets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.functions.ids import IMAGE_EXTENSIONS, basename, is_image_file
from panelscope.functions.scalars import one_hot
from panelscope.operators.projections import base_amplify_meta
from panelscope.schema import IMAGE_STRUCT, KEY, SCHEMA_SAMPLES_IMAGE, cast_to_schema
from panelscope.session import scratch_dir, written


def _paths(dirs) -> list[str]:
    return [str(dirs)] if isinstance(dirs, (str, bytes)) or not isinstance(dirs, Sequence) else [str(d) for d in dirs]


def _strip_scheme(c: Column) -> Column:
    return F.regexp_replace(c, r"^file:(//)?", "")


def case_insensitive_glob(extensions: Sequence[str] = IMAGE_EXTENSIONS) -> str:
    """``*.{[pP][nN][gG],...}``: a Hadoop glob for the extensions, any case."""
    def ci(ext: str) -> str:
        return "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in ext.lstrip("."))

    return "*.{" + ",".join(ci(e) for e in extensions) + "}"


#: Splits of a scan that one task reads at most: of small files a split holds some 32, by Spark's cost of opening a file.
SPLITS = 16


def packed(files: DataFrame) -> DataFrame:
    """A scan of files with up to SPLITS of its splits in a task, and no fewer than four tasks a core."""
    least = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(least, -(-files.rdd.getNumPartitions() // SPLITS)))


def list_samples(
    spark: SparkSession,
    dirs,
    glob_pat: str = "*.*",
    recursive: bool = True,
    predicate: Column | None = None,
) -> DataFrame:
    """Files under one or more folders matching ``glob_pat`` (file name) and
    accepted by ``predicate`` (a Column over ``path``; default: image
    extension). Only the listing is read, never the file contents."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob_pat)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = packed(reader.load(_paths(dirs)).select(_strip_scheme(F.col("path")).alias("path"), "length", "modificationTime"))
    pred = predicate if predicate is not None else is_image_file(F.col("path"))
    return df.where(pred)


def list_images(spark: SparkSession, dirs, recursive: bool = True, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """The image files under the folders as samples without pixels: paths,
    ``LABEL_SAMPLE_ID`` = file name, amplification metadata 0. Only the listing
    is read; ``read_pixels`` gives the pixels of the rows that are left in the end."""
    files = list_samples(spark, dirs, case_insensitive_glob(extensions), recursive, is_image_file(F.col("path"), extensions))
    path = F.col("path")
    out = base_amplify_meta(files.select(path.alias("SAMPLE_PATH"), path.alias("SAMPLE_PATH_CATEGORY"), basename(path).alias(KEY)))
    return cast_to_schema(out, T.StructType([f for f in SCHEMA_SAMPLES_IMAGE if f.name != "SAMPLE"]))


#: Files opened by one block of ``read_pixels``: so many paths are with the driver at a time.
BLOCK_FILES = 50_000


def _origin_path(origin) -> Column:
    """The path of an image's origin, a URI in which percent signs are decoded and plus signs are not."""
    return F.try_url_decode(F.replace(_strip_scheme(origin), F.lit("+"), F.lit("%2B")))


#: Tasks that look up the paths of a block; Spark's own figure is one a path, up to 10,000.
LOOKUP_TASKS, LOOKUP_CONF = 64, "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _images_at(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The image source over just these files."""
    before = spark.conf.get(LOOKUP_CONF)
    spark.conf.set(LOOKUP_CONF, str(min(int(before), LOOKUP_TASKS)))
    try:
        return packed(spark.read.format("image").option("dropInvalid", "false").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]))
    finally:
        spark.conf.set(LOOKUP_CONF, before)


def read_pixels(rows: DataFrame, path_col: str = "SAMPLE_PATH", col: str = "SAMPLE", channels: int | None = None, counts: dict | None = None, block: int = BLOCK_FILES) -> DataFrame:
    """``rows`` with the image of the file at ``path_col``, decoded once each.

    The rows are written first, so what selected them is not done again. Then,
    in blocks of about ``block`` files, the image source opens just the files
    of the block, and their pixels meet the block's rows, which are sent to the
    tasks (beyond twice the block, where paths repeat, they are joined by
    shuffle). The blocks are appended to one table: pixels are neither shuffled nor decoded again later.

    A file that doesn't decode, and a null path, give a null image; ``channels=3``
    makes every image BGR. ``counts`` receives ``decoded`` and ``failed`` files.
    A file that has gone since it was listed is an error."""
    spark = rows.sparkSession
    schema = T.StructType([*[f for f in rows.schema if f.name != col], T.StructField(col, IMAGE_STRUCT)])
    narrow = written(rows.drop(col), "listed")
    n = narrow.agg(F.count_distinct(path_col)).first()[0]
    target = scratch_dir(spark, "pixels")
    seen = {"decoded": 0, "failed": 0}
    blocks = -(-n // block)
    for b in range(blocks):
        part = narrow.where(F.col(path_col).isNotNull() & (F.pmod(F.xxhash64(path_col), F.lit(blocks)) == b))
        paths = [r[0] for r in part.select(path_col).distinct().collect()]  # about ``block`` of them
        if not paths:
            continue
        images = _images_at(spark, paths)
        found = images.select(_origin_path(F.col("image.origin")).alias("_path"), F.when(F.col("image.nChannels") > 0, F.col("image")).alias(col))
        watch = Observation()
        found = found.observe(watch, F.count(col).alias("decoded"), F.count_if(F.col(col).isNull()).alias("failed"))
        if channels == 3:
            from panelscope.operators.images import to_bgr

            found = to_bgr(found, col)
        side = F.broadcast(part) if part.count() <= 2 * block else part
        joined = found.join(side, F.col("_path") == F.col(path_col)).select(*schema.names)
        joined.write.mode("append").parquet(target)
        seen = {k: v + watch.get[k] for k, v in seen.items()}
    without = narrow.where(F.col(path_col).isNull()).withColumn(col, F.lit(None).cast(IMAGE_STRUCT)).select(*schema.names)
    without.write.mode("append").parquet(target)
    if counts is not None:
        counts.update(seen)
    return spark.read.schema(schema).parquet(target)


def scan_images(spark: SparkSession, dirs, recursive: bool = True, extensions=IMAGE_EXTENSIONS, invalid: str = "keep", channels: int | None = None) -> DataFrame:
    """All images under the folders as samples: ``SAMPLE`` (image struct, BGR),
    paths, ``LABEL_SAMPLE_ID`` = file name, amplification metadata 0.
    Rows of files that do not decode stay, with a NULL ``SAMPLE``;
    ``invalid="drop"`` leaves them out. ``channels=3`` makes every image BGR.

    It decodes whatever it reads: to filter by labels first, use ``list_images`` and ``read_pixels``."""
    if invalid not in ("keep", "drop"):
        raise ValueError(f"invalid is keep or drop, got {invalid!r}.")
    reader = spark.read.format("image").option("dropInvalid", str(invalid == "drop").lower()).option("pathGlobFilter", case_insensitive_glob(extensions))
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    img = packed(reader.load(_paths(dirs)))
    path = _origin_path(F.col("image.origin"))
    out = img.select(
        F.when(F.col("image.nChannels") > 0, F.col("image")).alias("SAMPLE"),
        path.alias("SAMPLE_PATH"),
        path.alias("SAMPLE_PATH_CATEGORY"),
        basename(path).alias(KEY),
    )
    if channels == 3:
        from panelscope.operators.images import to_bgr

        out = to_bgr(out)
    return cast_to_schema(base_amplify_meta(out), SCHEMA_SAMPLES_IMAGE)


def parent_dir(path) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]+)/[^/]+$", 1)


def scan_dir_as_label(
    spark: SparkSession,
    root: str,
    classes: Sequence[str] | None = None,
    extensions=IMAGE_EXTENSIONS,
) -> DataFrame:
    """Images under ``root/<class>/...``: class = parent folder name, index in
    ``classes`` (default: the folder names sorted), one-hot label."""
    imgs = scan_images(spark, root, extensions=extensions)
    cls = parent_dir(F.col("SAMPLE_PATH"))
    if classes is None:
        # the class list is the set of folder names: bounded by the folder count; from the listing, which decodes nothing
        listed = list_images(spark, root, extensions=extensions)
        classes = sorted(r[0] for r in listed.select(cls.alias("c")).distinct().collect())
    arr = F.array(*[F.lit(c) for c in classes])
    idx = (F.array_position(arr, cls) - 1).cast("int")
    return (
        imgs.withColumn("class_name", cls)
        .withColumn("label", F.when(idx >= 0, idx))
        .withColumn("one_hot", one_hot(F.col("label"), len(classes)))
        .where(F.col("label").isNotNull())
    )


def scan_images_gray_by_dir(spark: SparkSession, root: str, categories: Sequence[str], size: int = 50) -> DataFrame:
    """For each category folder (index in the list = label) read images as
    gray, resize to ``size``×``size``; unreadable files are skipped."""
    from panelscope.operators.images import resize, to_gray

    df = scan_dir_as_label(spark, root, classes=list(categories)).where("SAMPLE is not null")
    return resize(to_gray(df), size, size).select("SAMPLE", "SAMPLE_PATH", "label")


def scan_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header; give ``schema`` in production, inference otherwise."""
    r = spark.read.option("header", "true")
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", "true").csv(path)


def read_array_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
