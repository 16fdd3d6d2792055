"""Labelled image datasets from files: the user-level entry point.

``load_image_dataset`` = label file(s) ⨝ the listing of image folder(s) under
the declared full schema, with the merge guards. No pixel is read for that:
filters, ranking and splitting work on narrow rows, and ``pixels`` (or
``prepare_for_training``) reads the images of the rows that are left, each once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.functions.scalars import LABEL_NAMES
from panelscope.operators.augment import StructImage, amplification, amplify
from panelscope.operators.filters import DEFAULT_FILTER, Dataset
from panelscope.operators.joins import merge_labels_samples
from panelscope.operators.splits import split_exact
from panelscope.schema import SCHEMA_FULL_ELPV, cast_to_schema
from panelscope.session import written
from panelscope.sources.files import list_images, read_pixels
from panelscope.sources.labels import scan_labels


@dataclass
class ImageDataset(Dataset):
    """A :class:`Dataset` whose rows have no pixels yet; ``counts`` tells how
    many files the last ``pixels`` decoded and failed to decode."""

    channels: int | None = None
    counts: dict = field(default_factory=dict)

    def pixels(self, rows: DataFrame | None = None) -> DataFrame:
        """The current data (or ``rows``) with images."""
        return read_pixels(self.current if rows is None else rows, channels=self.channels, counts=self.counts)


def load_image_dataset(
    spark: SparkSession,
    label_path: str,
    sample_dirs: str | Sequence[str],
    default_filter: str | None = DEFAULT_FILTER,
    check: str = "counts",
    channels: int | None = None,
) -> ImageDataset:
    """Labels ⨝ image files on the sample id (full outer, guarded), cast to the
    full schema without pixels; the default predicate is applied to the current
    data. A predicate on label columns is pushed below the join by Catalyst.
    ``channels=3`` makes every image BGR when it is read."""
    labels = scan_labels(spark, label_path)
    narrow = T.StructType([f for f in SCHEMA_FULL_ELPV if f.name != "SAMPLE"])
    merged = merge_labels_samples(labels, list_images(spark, sample_dirs), check=check)
    ds = ImageDataset(cast_to_schema(merged, narrow), channels=channels)
    if default_filter:
        ds.filter(default_filter)
    return ds


def prepare_for_training(
    ds: Dataset,
    train_frac: float = 0.65,
    seed: int = 0,
    amplify_data: bool = True,
    semantics: str = "documented",
) -> DataFrame:
    """Current data -> (amplified) -> exact train/test split column.

    Of an :class:`ImageDataset` the ids are ranked and the split is drawn without
    pixels; then each image is decoded once, and an amplified image goes to the
    pixel kernel once for all its variants. Rows without a file are left out of it."""
    if not isinstance(ds, ImageDataset):
        data = amplify(ds.current, StructImage("SAMPLE"), semantics=semantics) if amplify_data else ds.current
        return split_exact(data, train_frac, seed=seed)
    base = written(ds.current.where(F.col("SAMPLE_PATH").isNotNull()), "selected")
    if not amplify_data:
        return ds.pixels(split_exact(base, train_frac, seed=seed))
    grown = amplification(base, semantics=semantics)
    images = grown.expand(StructImage("SAMPLE"), ds.pixels(grown.rows))
    return split_exact(images, train_frac, seed=seed, keys=grown.expand(None))


def write_training_layout(split_df: DataFrame, target: str, label_names: Sequence[str] = LABEL_NAMES, **kw) -> None:
    """``target/train|validate/<category>/<id>``: image files that a trainer (or ``scan_dir_as_label``) reads by folder."""
    from panelscope.sources.sinks import write_category_folders

    write_category_folders(split_df, target, label_names, **kw)
