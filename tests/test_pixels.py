"""Single operators against their definition, on drawn images (square, not square, of three channels, of one pixel, empty)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.functions import pixels as px
from panelscope.operators.augment import ArrayImage
from panelscope.operators.images import mirror_images, rotate_images, rotate_square_images, translate_images

RNG = np.random.default_rng(17)
#: 4x4 and 5x5, one channel; 3x3 and 4x4 with three.
GRIDS = [RNG.integers(0, 90, (n, n)) for n in (4, 5)]
COLORED = [RNG.integers(0, 255, (n, n, 3)) for n in (3, 4)]
SMALL = GRIDS[0].tolist()
IMG = ArrayImage("a", "h", "w", "c")


def by_definition(a, source):
    """The image whose pixel (r, q) is the pixel ``source(r, q, h, w)`` of ``a``, where the result has the shape that ``source`` gives for None."""
    h, w = a.shape[:2]
    out = np.empty((*source(None, None, h, w), *a.shape[2:]), a.dtype)
    for r in range(out.shape[0]):
        for q in range(out.shape[1]):
            out[r, q] = a[source(r, q, h, w)]
    return out


def mirrored(axis):
    def source(r, q, h, w):
        if r is None:
            return (w, h) if axis > 2 else (h, w)
        return {1: lambda: (h - 1 - r, q), 2: lambda: (r, w - 1 - q), 3: lambda: (q, r), 4: lambda: (h - 1 - q, w - 1 - r)}[axis]()

    return source


def turned(degrees):
    def source(r, q, h, w):
        quarter = degrees % 360 // 90
        if r is None:
            return (w, h) if quarter % 2 else (h, w)
        # a quarter turn counter-clockwise brings the last column to the top
        return [(r, q), (q, w - 1 - r), (h - 1 - r, w - 1 - q), (h - 1 - q, r)][quarter]

    return source


def frame(spark, imgs):
    rows = []
    for m in imgs:
        a = np.asarray(m, dtype=float)
        if a.ndim == 1:
            a = a.reshape(1, -1) if a.size else a.reshape(0, 0)
        h, w = a.shape[:2]
        rows.append(([float(x) for x in a.ravel()], h, w, a.shape[2] if a.ndim == 3 else 1))
    return spark.createDataFrame(rows, "a array<double>, h int, w int, c int")


def grid(row):
    return np.asarray(row["a"]).reshape(row["h"], row["w"]).astype(int).tolist()


def cube(row):
    return np.asarray(row["a"]).reshape(row["h"], row["w"], row["c"]).astype(int)


@pytest.mark.parametrize("axis", [1, 2, 3, 4])
def test_mirrors_by_definition(spark, axis):
    out = mirror_images(frame(spark, GRIDS), IMG, axis).collect()
    assert [grid(r) for r in out] == [by_definition(a, mirrored(axis)).tolist() for a in GRIDS]
    out = mirror_images(frame(spark, COLORED), IMG, axis).collect()
    assert all((cube(r) == by_definition(a, mirrored(axis))).all() for r, a in zip(out, COLORED, strict=True))


@pytest.mark.parametrize("deg", [90, 180, 270, 450, -90])
def test_rotations_by_definition(spark, deg):
    wide = [RNG.integers(0, 90, (2, 5)), RNG.integers(0, 90, (4, 3))]
    for images in (GRIDS, wide):
        out = rotate_images(frame(spark, images), IMG, deg).collect()
        assert [grid(r) for r in out] == [by_definition(a, turned(deg)).tolist() for a in images]
    out = rotate_images(frame(spark, COLORED), IMG, deg).collect()
    assert all((cube(r) == by_definition(a, turned(deg))).all() for r, a in zip(out, COLORED, strict=True))


def test_rotation_of_image_structs_that_are_not_square(spark):
    from panelscope.operators.augment import StructImage

    a = RNG.integers(0, 255, (2, 5, 3)).astype(np.uint8)
    df = spark.createDataFrame([(("o", 2, 5, 3, 16, a.tobytes()),)], "SAMPLE struct<origin string, height int, width int, nChannels int, mode int, data binary>")
    s = rotate_images(df, StructImage("SAMPLE"), 90).first()["SAMPLE"]
    assert (np.frombuffer(s["data"], np.uint8).reshape(s["height"], s["width"], 3) == by_definition(a, turned(90))).all()
    with pytest.raises(Exception, match="square"):
        rotate_square_images(df, StructImage("SAMPLE"), 90).collect()


def test_no_turn_and_full_turn(spark):
    for d in (0, 360):
        assert [grid(r) for r in rotate_images(frame(spark, GRIDS), IMG, d).collect()] == [a.tolist() for a in GRIDS]


def test_single_pixel_and_empty_pass_unchanged(spark):
    df = frame(spark, [[1], []])
    for d in (90, 180, 270):
        got = [r["a"] for r in rotate_images(df, IMG, d).collect()]
        assert got == [[1.0], []]


def test_rotation_not_multiple_of_90(spark):
    with pytest.raises(ValueError):
        rotate_images(frame(spark, [SMALL]), IMG, 45)


def test_bad_mirror_axis(spark):
    with pytest.raises(ValueError):
        mirror_images(frame(spark, [SMALL]), IMG, 5)


@pytest.mark.parametrize("shape", [(2, 3), (2, 4), (3, 2), (4, 2)])
def test_non_square_diagonal_mirror_and_rotation_fail(spark, shape):
    img = np.arange(np.prod(shape)).reshape(shape).tolist()
    df = frame(spark, [img])
    for op in (lambda d: mirror_images(d, IMG, 3), lambda d: mirror_images(d, IMG, 4), lambda d: rotate_square_images(d, IMG, 90)):
        with pytest.raises(Exception, match="square"):
            op(df).collect()


def test_non_square_row_mirror_ok(spark):
    a = RNG.integers(0, 90, (3, 7))
    out = mirror_images(frame(spark, [a]), IMG, 1).collect()
    assert grid(out[0]) == by_definition(a, mirrored(1)).tolist()


@pytest.mark.parametrize("bad", ["a string column", "x"])
def test_wrong_types(spark, bad):
    df = spark.createDataFrame([("x", 2, 2, 1)], "a string, h int, w int, c int")
    with pytest.raises(TypeError):
        mirror_images(df, IMG, 1)
    with pytest.raises(TypeError):
        rotate_images(frame(spark, [SMALL]), IMG, "90")


def test_translate_fraction_and_pixels(spark):
    img = np.arange(16).reshape(4, 4)
    df = frame(spark, [img.tolist()])
    got = grid(translate_images(df, IMG, 0.25, 0.5).first())
    assert got == np.roll(np.roll(img, 2, axis=0), 1, axis=1).tolist()
    got = grid(translate_images(df, IMG, -1, 3).first())
    assert got == np.roll(np.roll(img, 3, axis=0), -1, axis=1).tolist()
    # translate(t) then translate(-t) is the identity
    back = translate_images(translate_images(df, IMG, 0.25, -0.25), IMG, -0.25, 0.25)
    assert grid(back.first()) == img.tolist()


def test_translate_bounds_and_types(spark):
    df = frame(spark, [SMALL])
    with pytest.raises(ValueError):
        translate_images(df, IMG, 1.2, 0.0)
    translate_images(df, IMG, 1.2, 0.0, semantics="observed")
    with pytest.raises(ValueError):
        translate_images(df, IMG, 1.6, 0.0, semantics="observed")
    with pytest.raises(TypeError):
        translate_images(df, IMG, "1", 0)


def test_observed_translation_semantics(spark):
    # observed: x rolls rows by a share of the width; (±1, 0) is a no-op
    img = np.arange(12).reshape(3, 4)
    df = frame(spark, [img.tolist()])
    got = grid(translate_images(df, IMG, 0.25, 0.0, semantics="observed").first())
    assert got == np.roll(img, 1, axis=0).tolist()
    got = grid(translate_images(df, IMG, 1, 0, semantics="observed").first())
    assert got == img.tolist()


def test_properties_mirror_twice_and_rot90_four_times(spark):
    rng = np.random.default_rng(3)
    imgs = [rng.integers(0, 9, size=(5, 5)).tolist() for _ in range(4)]
    df = frame(spark, imgs)
    for axis in (1, 2, 3, 4):
        twice = mirror_images(mirror_images(df, IMG, axis), IMG, axis)
        assert [grid(r) for r in twice.collect()] == imgs
    r4 = df
    for _ in range(4):
        r4 = rotate_images(r4, IMG, 90)
    assert [grid(r) for r in r4.collect()] == imgs
    # transpose == rot90 after a left-right flip
    t = [grid(r) for r in mirror_images(df, IMG, 3).collect()]
    assert t == [np.rot90(np.fliplr(np.asarray(m))).tolist() for m in imgs]


def test_shift_pixels(spark):
    df = spark.createDataFrame([(0.25, 8), (-0.25, 8), (0.5, 3), (1.0, 5)], "t double, n int")
    got = [r[0] for r in df.select(px.shift_pixels("t", "n", False)).collect()]
    assert got == [2, 6, 2, 0]  # round half even: 1.5 -> 2
    got = [r[0] for r in df.select(px.shift_pixels(F.lit(-3), "n", True)).collect()]
    assert got == [5, 5, 0, 2]


def test_array_to_binary_and_gray(spark):
    df = spark.createDataFrame([([0.0, 128.0, 129.0, 255.0],)], "a array<double>")
    assert df.select(px.to_binary("a")).first()[0] == [0.0, 0.0, 255.0, 255.0]
    bgr = spark.createDataFrame([([10.0, 20.0, 30.0, 255.0, 255.0, 255.0], 3)], "a array<double>, c int")
    assert bgr.select(px.to_gray("a", "c")).first()[0] == [round(0.114 * 10 + 0.587 * 20 + 0.299 * 30), 255.0]
