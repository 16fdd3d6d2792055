import os

import numpy as np
import pytest

from panelscope.operators.aggregates import distribution
from panelscope.sources.labels import load_labels

LINES = ["# head", "i/c1.png 0.0 poly", "", "i/c2.png", "i/c3.png x mono", "i/c4.png 1.0 mono # fine", "i/c5.png 1.2 mono", "i/c6.png 0.5", "i/c7.png 0.5 a b", "i/c8.png nan poly", "   ", "i/c9.png -0.1 poly"]
BAD = {4: "no probability", 5: "not a number", 7: "outside the bins", 8: "no type", 9: "too many fields", 12: "outside the bins"}


def test_rejects_have_file_line_and_reason(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(LINES) + "\n")
    load = load_labels(spark, str(tmp_path))
    got = {(os.path.basename(r["LABEL_FILENAME"]), r["line_no"]): (r["reason"], r["line"]) for r in load.rejects.collect()}
    assert got == {(f, n): (why, LINES[n - 1]) for f in ("a.txt", "b.txt") for n, why in BAD.items()}
    assert (load.lines, load.n_labels, load.n_rejects, load.probabilities) == (24, 6, 12, {0.0: 2, 1.0: 2})
    assert sorted(r["LABEL_SAMPLE_ID"] for r in load.labels.collect()) == ["c1.png", "c1.png", "c4.png", "c4.png", "c8.png", "c8.png"]
    assert load.require_values(2) is load
    with pytest.raises(ValueError, match="4 different"):
        load.require_values(4)
    with pytest.raises(ValueError, match=r"12 malformed.*a.txt:4 no probability"):
        load_labels(spark, str(tmp_path), strict=True)
    with pytest.raises(FileNotFoundError):
        load_labels(spark, str(tmp_path / "none"))


def test_line_numbers_over_many_blocks(spark, tmp_path):
    lines = [f"i/c{i}.png {'bad' if i % 97 == 0 else 0.5} poly" for i in range(1, 6001)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "empty.txt").write_text("")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        load = load_labels(spark, str(tmp_path), strict=False)
        got = sorted((r["line_no"], r["line"]) for r in load.rejects.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, lines[i - 1]) for i in range(97, 6001, 97)]
    assert load.probabilities == {0.5: 6000 - len(got)}


def test_many_values_are_not_listed(spark, tmp_path):
    (tmp_path / "l.txt").write_text("\n".join(f"i/c{i}.png {i / 100} poly" for i in range(100)))
    load = load_labels(spark, str(tmp_path / "l.txt"))
    assert load.probabilities is None and load.n_labels == 100
    with pytest.raises(ValueError, match="more than 64"):
        load.require_values(100)


def test_distribution_equals_numpy(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, 7000), rng.normal(6, 0.5, 3000)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    d = distribution(df, "v")
    hist = d.histogram.orderBy("bin").collect()
    edges = np.histogram_bin_edges(v, "fd")
    assert abs(len(hist) - min(50, len(edges) - 1)) <= 1
    want, _ = np.histogram(v, [hist[0]["lo"], *(r["hi"] for r in hist)])
    assert np.abs(np.array([r["n"] for r in hist]) - want).max() <= 1 and sum(r["n"] for r in hist) == d.n == 10_000
    x, y = map(np.array, zip(*((r["x"], r["density"]) for r in d.density.orderBy("x").collect())))
    band = v.std(ddof=1) * len(v) ** (-1 / 5)
    exact = np.exp(-0.5 * ((x[:, None] - v) / band) ** 2).sum(1) / (len(v) * band * np.sqrt(2 * np.pi))
    step = x[1] - x[0]
    assert np.abs(y - exact).max() <= 0.05 * (step / band) ** 2 / (band * np.sqrt(2 * np.pi))
    assert abs((y * step).sum() - 1) < 5e-3


def test_distribution_of_few_values(spark):
    f = lambda *v: spark.createDataFrame([(x,) for x in v], "v double")
    assert distribution(f(), "v").n == 0 and distribution(f(None), "v").histogram.count() == 0
    one = distribution(f(3.0, 3.0), "v")
    assert [tuple(r) for r in one.histogram.collect()] == [(0, 2.5, 3.5, 2)] and one.density.count() == 0
    spike = distribution(f(*[1.0] * 80, 0.0, 2.0), "v")  # equal quartiles
    assert sum(r["n"] for r in spike.histogram.collect()) == 82 and spike.density.count() == 512
