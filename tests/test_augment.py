import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators.augment import ArrayImage, add_mirrored, add_rotated, add_translated, amplify
from tests.brute import amplify_sim

IMG = ArrayImage("SAMPLE", "SAMPLE_H", "SAMPLE_W", "SAMPLE_C")


def _frame(spark, ids, n=3):
    rng = np.random.default_rng(7)
    rows = []
    for i in ids:
        img = rng.integers(0, 255, size=(n, n, 1))
        rows.append(dict(id=i, img=img, tx=0, ty=0, axis=0, deg=0))
    df = spark.createDataFrame(
        [(r["id"], [float(v) for v in r["img"].ravel()], n, n, 1, 0, 0, 0.0, 0.0) for r in rows],
        "LABEL_SAMPLE_ID string, SAMPLE array<double>, SAMPLE_H int, SAMPLE_W int, SAMPLE_C int, "
        "MIRROR_AXIS short, ROT_DEG short, TRANSL_X double, TRANSL_Y double",
    )
    return df, rows


def _collect(df):
    return {
        r["LABEL_SAMPLE_ID"]: (tuple(r["SAMPLE"]), r["MIRROR_AXIS"], r["ROT_DEG"], r["TRANSL_X"], r["TRANSL_Y"])
        for r in df.collect()
    }


def _expected(sim):
    return {
        r["id"]: (tuple(float(v) for v in np.asarray(r["img"]).ravel()), r["axis"], r["deg"], float(r["tx"]), float(r["ty"]))
        for r in sim
    }


@pytest.mark.parametrize("semantics", ["documented", "observed"])
def test_amplify_matches_stagewise_simulation(spark, semantics):
    ids = ["cell0003.png", "cell0010.png", "cell0007.png", "cell0042.png", "cell0001.png"]
    df, rows = _frame(spark, ids)
    tr = [(0.25, 0.25), (-0.25, -0.25)] if semantics == "documented" else [(0.25, 0.25)]
    out = amplify(df, IMG, tr, (1, 2, 3, 4), (90, 180, 270), semantics=semantics, num_buckets=3)
    got = _collect(out)
    assert out.count() == len(ids) * (1 + len(tr)) * 5 * 4
    if semantics == "documented":
        assert got == _expected(amplify_sim(rows, tr, (1, 2, 3, 4), (90, 180, 270)))
    else:
        exp = amplify_sim(rows, tr, (1, 2, 3, 4), (90, 180, 270), semantics="observed")
        assert set(got) == {r["id"] for r in exp}


def test_amplify_width_grows_without_truncation(spark):
    ids = ["a9.png", "a8.png", "a7.png"]
    df, rows = _frame(spark, ids, n=2)
    out = amplify(df, IMG, [(1, 0)], (1,), (180,), num_buckets=2)
    got = _collect(out)
    assert got == _expected(amplify_sim(rows, [(1, 0)], (1,), (180,)))
    assert "a24.png" in got


def test_stagewise_equals_closed_form(spark):
    ids = [f"img{i:03d}.bmp" for i in (5, 1, 9, 33, 2, 8)]
    df, _ = _frame(spark, ids)
    closed = _collect(amplify(df, IMG, num_buckets=4))
    staged = add_rotated(add_mirrored(add_translated(df, IMG, num_buckets=4), IMG, num_buckets=4), IMG, num_buckets=4)
    assert closed == _collect(staged)


def test_repeated_amplify_takes_stagewise_path(spark):
    ids = ["c01.png", "c02.png"]
    df, _ = _frame(spark, ids, n=2)
    once = amplify(df, IMG, [(0.5, 0.5)], (1,), (90,), num_buckets=2)
    twice = amplify(once, IMG, [(0.5, 0.5)], (1,), (90,), num_buckets=2)
    got = _collect(twice)
    assert len(got) == twice.count()  # ids stay unique


def test_parameter_errors(spark):
    df, _ = _frame(spark, ["x1.png"])
    with pytest.raises(TypeError):
        amplify(df, IMG, translations=5)
    with pytest.raises(ValueError):
        amplify(df, IMG, translations=[(0.1, 0.2, 0.3)])
    with pytest.raises(ValueError):
        amplify(df, IMG, mirror_axes=(5,))
    with pytest.raises(ValueError):
        amplify(df, IMG, rotations=(45,))
    with pytest.raises(ValueError):
        amplify(df, IMG, translations=[(1.2, 0.0)])
    amplify(df, IMG, translations=[(1.2, 0.0)], semantics="observed")
    bad, _ = _frame(spark, ["nodigits.png"])
    with pytest.raises(ValueError):
        amplify(bad, IMG)
