"""A whole training run on a labelled image dataset, with reuse of a saved model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.functions.scalars import LABEL_NAMES
from panelscope.operators.aggregates import accuracy_and_loss, image_shape, single_value_guard
from panelscope.operators.convnet import DEFECT_LAYERS, ConvNet
from panelscope.operators.images import resize, to_binary, to_bgr, to_feature_vector, to_gray
from panelscope.operators.learn import score_summary
from panelscope.plans.datasets import ImageDataset, prepare_for_training
from panelscope.schema import KEY
from panelscope.session import written

COLORS = {"binary": to_binary, "gray": to_gray, "rgb": to_bgr}


@dataclass
class TrainingRun:
    """``predictions``: a row per test image with its class probabilities (see ``score_summary``);
    ``evaluation``: accuracy, loss and ``n`` of them; ``losses`` by round if ``fitted``, else none."""

    model: ConvNet
    fitted: bool
    losses: list[float]
    predictions: DataFrame
    evaluation: dict[str, float]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def train_or_load(
    ds: ImageDataset,
    model_path: str,
    force_retrain: bool = False,
    color: str = "binary",
    amplify_data: bool = True,
    train_frac: float = 0.65,
    seed: int = 0,
    layers: Sequence[tuple] = DEFECT_LAYERS,
    label_names: Sequence[str] = LABEL_NAMES,
    size: tuple[int, int] | None = None,
    **fit,
) -> TrainingRun:
    """One panel type only -> pixels, color, one shape -> (amplified) split -> the
    model at ``model_path`` if there is one, else (or with ``force_retrain``) fit
    and save it there -> probabilities, accuracy and loss of the test part.

    ``size`` resizes the images first; else all must have one shape. A saved model
    for images of another shape is refused. Images that don't decode and rows without a category are not trained on, and
    the latter aren't counted in the evaluation. ``fit`` goes to ``ConvNet.fit``."""
    spark = ds.current.sparkSession
    single_value_guard(ds.current, "TYPE")
    data = COLORS[color](prepare_for_training(ds, train_frac, seed, amplify_data).where("SAMPLE is not null"))
    if size:
        data = resize(data, *size)
    names = F.array(*[F.lit(n) for n in label_names])
    label = F.nullif(F.array_position(names, F.col("LABEL_CATEGORY")), F.lit(0)).cast("int") - 1
    # pixels are made once for fitting and evaluation
    data = written(data.select(KEY, "split", "SAMPLE", label.alias("label")), "train-data")
    image = (*image_shape(data, "SAMPLE.height", "SAMPLE.width", "SAMPLE.nChannels"), 3 if color == "rgb" else 1)
    rows = data.withColumn("features", to_feature_vector("SAMPLE", 1.0 / 255)).drop("SAMPLE")
    fitted = force_retrain or not _exists(spark, model_path)
    losses: list[float] = []
    if fitted:
        model = ConvNet(image, tuple(layers), seed)
        losses = model.fit(rows.where("split = 'train'"), "features", "label", **fit)
        model.save(spark, model_path)
    else:
        model = ConvNet.load(spark, model_path)
        if model.image != image:
            raise ValueError(f"The model at {model_path} is for images {model.image}, these are {image}.")
    scored = written(rows.where("split = 'test'").withColumn("probs", model.probabilities("features")).drop("features"), "scored")
    known = scored.where("label is not null")
    result = accuracy_and_loss(known, "probs", "label").first().asDict() | {"n": known.count()}
    return TrainingRun(model, fitted, losses, score_summary(scored, "probs", "label", label_names), result)
