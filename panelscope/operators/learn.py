"""Model fitting, scoring and summaries with Spark ML.

The reference trains Keras networks; here the same tasks (image class from
pixels, defect category from an image) are re-aimed at spark.ml estimators
on feature vectors, and any Python model can score batches through
``predict_batch_udf``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.functions.scalars import argmax, is_correct, max_conf
from panelscope.session import scratch_dir


def stored(model, path: str):
    """``model`` as it reads back from ``path``, where it is saved. A fitted
    model holds its training summary, and with it the session, which tasks can't
    be sent once the session has counted rows by ``observe``; the saved one doesn't."""
    model.write().overwrite().save(path)
    return type(model).load(path)


def with_features(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def mlp_classifier(train: DataFrame, features: str, label: str, n_inputs: int, n_classes: int, hidden: int = 128, seed: int = 42, max_iter: int = 100):
    """Dense hidden layer + output layer on rescaled pixels."""
    mlp = MultilayerPerceptronClassifier(
        layers=[n_inputs, hidden, n_classes], featuresCol="features", labelCol="_label", seed=seed, maxIter=max_iter
    )
    data = with_features(train, features).withColumn("_label", F.col(label).cast("double"))
    return mlp.fit(data)


def classify_defects(train: DataFrame, features: str, category_col: str = "LABEL_CATEGORY", max_iter: int = 50):
    """Category (string) from pixels: index the labels, multinomial logistic regression.

    Training rows without a category are left out. The model scores every row,
    whatever its category: a missing one, or one unseen in training, gets the
    index after the last."""
    data = with_features(train.where(F.col(category_col).isNotNull()), features)
    idx = StringIndexer(inputCol=category_col, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(data)
    lr = LogisticRegression(featuresCol="features", labelCol="_label", family="multinomial", maxIter=max_iter)
    # fitted without the indexer's metadata: the extra index is no class of the model
    model = PipelineModel(stages=[idx, lr.fit(idx.transform(data).withMetadata("_label", {}))])
    return stored(model, scratch_dir(train.sparkSession, "model"))


def class_centroids(train: DataFrame, features: str, label: str) -> tuple[list[int], np.ndarray]:
    """Mean feature vector per class (a classes × features matrix — bounded
    by the class count, not by the data): one aggregate over vectors, summed up per partition first."""
    means = with_features(train, features).groupBy(F.col(label).alias("c")).agg(Summarizer.mean(F.col("features")).alias("m")).orderBy("c").collect()
    return [r["c"] for r in means], np.array([r["m"].toArray() for r in means])


def centroid_predict_fn(centroids: np.ndarray):
    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            d = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
            z = -d
            z = z - z.max(axis=1, keepdims=True)
            e = np.exp(z)
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return make


def batch_infer(df: DataFrame, features: str, make_predict_fn, n_inputs: int, batch_size: int = 256, out: str = "probs") -> DataFrame:
    """Score a feature-array column with any numpy model, Arrow batch by batch."""
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[n_inputs]])
    return df.withColumn(out, udf(F.col(features).cast("array<double>")))


def score_summary(df: DataFrame, probs: str, label: str, class_names: Sequence[str] | None = None) -> DataFrame:
    """Predicted class (name), confidence %, true class, correct?"""
    pred = argmax(probs)
    name = F.element_at(F.array(*[F.lit(n) for n in class_names]), pred + 1) if class_names else pred.cast("string")
    return df.select(
        "*",
        pred.alias("pred"),
        name.alias("class_name"),
        max_conf(probs).alias("confidence"),
        is_correct(pred, F.col(label)).alias("correct"),
    )


def train_test_arrays(split_df: DataFrame, features: str, label: str, split_col: str = "split"):
    """(train, test) frames of (features, label). The test part really holds
    the test rows (the reference returned the training rows there, D9)."""
    cols = [F.col(features).alias("features"), F.col(label).alias("label")]
    return (
        split_df.where(F.col(split_col) == "train").select(*cols),
        split_df.where(F.col(split_col) == "test").select(*cols),
    )
