import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators.convnet import DEFECT_LAYERS, ConvNet, shapes
from panelscope.sources.sinks import png_bytes


def test_gradient_equals_a_difference_quotient():
    rng = np.random.default_rng(1)
    for image, layers in [
        ((7, 6, 2), (("conv", 3, 2), ("pool", 2), ("conv", 4, 2), ("dense", 5), ("dense", 3))),
        ((5, 5, 1), (("pool", 2), ("dense", 3))),
        ((4, 4, 1), (("dense", 6), ("dense", 3))),
    ]:
        net = ConvNet(image, layers, seed=2)
        x, y = rng.normal(size=(4, *image)), np.array([0, 1, 2, 1])
        _, gradient = net.loss_and_gradient(x, y)
        at = lambda w: ConvNet(image, layers, 0, w).loss_and_gradient(x, y)[0]
        by_quotient = [(at(net.weights + 1e-6 * e) - at(net.weights - 1e-6 * e)) / 2e-6 for e in np.eye(len(net.weights))]
        assert np.abs(gradient - by_quotient).max() < 1e-7


def test_layers_fit_the_image():
    assert shapes((300, 300, 1), DEFECT_LAYERS)[0] == (10, 16) and shapes((300, 300, 1), DEFECT_LAYERS)[-1] == (513, 4)
    with pytest.raises(ValueError, match="too small"):
        ConvNet((8, 8, 1), DEFECT_LAYERS)
    with pytest.raises(ValueError, match="Unknown"):
        ConvNet((8, 8, 1), (("lstm", 3),))


def test_fit_averages_tasks_and_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 4, 4, 1))
    x[y == 1, :2] += 2
    rows = [(a.ravel().tolist(), int(b)) for a, b in zip(x, y)] + [(None, 1), ([0.0] * 16, None)]
    df = spark.createDataFrame(rows, "x array<double>, y int")
    net = ConvNet((4, 4, 1), (("conv", 4, 2), ("dense", 2)), seed=1)
    start = net.weights.copy()
    losses = net.fit(df, "x", "y", rounds=4, workers=3)
    assert losses[-1] < losses[0] and (net.weights != start).any()
    # of one worker and one step a round: plain gradient descent
    one = ConvNet((4, 4, 1), (("dense", 2),), seed=1)
    want = one.weights - 0.1 * one.loss_and_gradient(x[:200], y[:200])[1]
    one.fit(spark.createDataFrame(rows[:200], df.schema), "x", "y", rounds=1, rate=0.1, batch=1000, workers=1)
    assert np.allclose(one.weights, want)
    path = f"{tmp_path}/net"
    net.save(spark, path)
    back = ConvNet.load(spark, path)
    assert (back.weights == net.weights).all() and (back.image, back.layers) == (net.image, net.layers)
    got = df.withColumn("p", back.probabilities("x")).collect()
    assert got[-2]["p"] is None
    probs = np.array([r["p"] for r in got[:300]])
    assert np.allclose(probs, net.predict(x)) and (probs.argmax(1) == y).mean() > 0.9
    with pytest.raises(ValueError, match="No rows"):
        net.fit(df.where("x is null"), "x", "y", rounds=1)


def test_second_run_fits_nothing_and_predicts_the_same(spark, tmp_path):
    from panelscope.plans.datasets import load_image_dataset
    from panelscope.plans.training import train_or_load

    rng, lines = np.random.default_rng(5), []
    os.makedirs(tmp_path / "img")
    for i in range(40):
        bad = i % 2
        a = rng.integers(0, 90, (6, 6, 1), dtype=np.uint8) + (150 if bad else 0)
        (tmp_path / "img" / f"cell{i:03d}.png").write_bytes(png_bytes(a.astype(np.uint8)))
        lines.append(f"img/cell{i:03d}.png {float(bad)} {'mono' if i > 35 else 'poly'}")
    (tmp_path / "labels.txt").write_text("\n".join(lines))
    load = lambda f: load_image_dataset(spark, str(tmp_path / "labels.txt"), str(tmp_path / "img"), default_filter=f)
    net = (("conv", 4, 3), ("pool", 2), ("dense", 4))
    run = lambda **kw: train_or_load(load("TYPE = 'poly'"), str(tmp_path / "model"), color="gray", amplify_data=False, layers=net, rounds=25, rate=0.2, workers=1, **kw)
    first = run()
    assert first.fitted and len(first.losses) == 25 and first.evaluation["accuracy"] == 1.0 and first.evaluation["n"] == 13
    probs = lambda r: sorted((x["LABEL_SAMPLE_ID"], x["probs"], x["class_name"]) for x in r.predictions.collect())
    second = run()
    assert not second.fitted and second.losses == [] and probs(second) == probs(first)
    assert {c for _, _, c in probs(first)} == {"pass", "fail"}
    assert run(force_retrain=True).fitted
    with pytest.raises(ValueError, match="for images"):
        run(size=(8, 8))
    with pytest.raises(ValueError, match="TYPE"):
        train_or_load(load(None), str(tmp_path / "other"), layers=net)
