"""Image-struct kernels (Spark's ``image`` source layout: row-major bytes,
BGR channel order, 8-bit modes).

Pixels are only touched here, in Arrow-batched pandas UDFs. Inside a batch
the rows with the same shape and parameters are stacked and moved with one
numpy call, so the Python cost is per batch and group, not per pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.functions.util import as_col
from panelscope.operators.ranking import hash_order_key
from panelscope.schema import IMAGE_STRUCT

# OpenCV type codes used by Spark's image source, by channel count (8-bit).
MODE_BY_CHANNELS = {1: 0, 3: 16, 4: 24}
# Fixed values that must equal the reference's: BGR -> gray weights.
GRAY_WEIGHTS_BGR = (0.114, 0.587, 0.299)


def _geometry_stack(stack: np.ndarray, dx: int, dy: int, axis: int, deg: int) -> np.ndarray:
    """stack: (N, h, w, c). rotate(mirror(translate(img)))."""
    if dx or dy:
        stack = np.roll(stack, shift=(dy, dx), axis=(1, 2))
    if axis == 1:
        stack = stack[:, ::-1]
    elif axis == 2:
        stack = stack[:, :, ::-1]
    elif axis == 3:
        stack = np.swapaxes(stack, 1, 2)
    elif axis == 4:
        stack = np.swapaxes(stack[:, ::-1, ::-1], 1, 2)
    if deg % 360:
        stack = np.rot90(stack, k=(deg % 360) // 90, axes=(1, 2))
    return stack


def _struct_frame(origin, height, width, channels, data) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "origin": origin,
            "height": height,
            "width": width,
            "nChannels": channels,
            "mode": [None if c is None else MODE_BY_CHANNELS.get(int(c), 0) for c in channels],
            "data": data,
        }
    )


NOT_SQUARE = "Only a square image can be mirrored or turned like this, not one of {}x{}."


def _moved(img: pd.DataFrame, dx: pd.Series, dy: pd.Series, axis: pd.Series, deg: pd.Series, turn_square: bool) -> pd.DataFrame:
    n = len(img)
    heights, widths = [None] * n, [None] * n
    chans, datas = [None] * n, [None] * n
    valid = img["data"].notna() & img["height"].notna()
    keys = pd.DataFrame(
        {"h": img["height"], "w": img["width"], "c": img["nChannels"], "dx": dx.fillna(0), "dy": dy.fillna(0),
         "a": axis.fillna(0), "d": deg.fillna(0)}
    )[valid]
    raw = img["data"].to_numpy()
    for (h, w, c, gx, gy, ga, gd), idx in keys.groupby(list(keys.columns)).groups.items():
        idx = np.asarray(idx)
        h, w, c = int(h), int(w), int(c)
        if (int(ga) in (3, 4) or (turn_square and int(gd) % 360)) and h != w and h * w > 1:
            raise ValueError(NOT_SQUARE.format(h, w))
        # one buffer, one reshape, one numpy move for the whole group
        stack = np.frombuffer(b"".join(raw[idx]), dtype=np.uint8).reshape(len(idx), h, w, c)
        moved = np.ascontiguousarray(_geometry_stack(stack, int(gx), int(gy), int(ga), int(gd)))
        _, ho, wo, _ = moved.shape
        flat = moved.reshape(len(idx), -1)
        for j, i in enumerate(idx):
            heights[i], widths[i], chans[i], datas[i] = ho, wo, c, flat[j].tobytes()
    return _struct_frame(img["origin"].tolist(), heights, widths, chans, datas)


@F.pandas_udf(IMAGE_STRUCT)
def _geometry_udf(img: pd.DataFrame, dx: pd.Series, dy: pd.Series, axis: pd.Series, deg: pd.Series) -> pd.DataFrame:
    return _moved(img, dx, dy, axis, deg, turn_square=True)


@F.pandas_udf(IMAGE_STRUCT)
def _geometry_udf_any(img: pd.DataFrame, dx: pd.Series, dy: pd.Series, axis: pd.Series, deg: pd.Series) -> pd.DataFrame:
    return _moved(img, dx, dy, axis, deg, turn_square=False)


def geometry_kernel(img, dx, dy, axis, deg, turn_square: bool = True) -> Column:
    """Image struct -> rotate(mirror(roll(img, dy rows, dx cols))) per row; with
    ``turn_square`` only square images may be turned."""
    return (_geometry_udf if turn_square else _geometry_udf_any)(as_col(img), as_col(dx).cast("int"), as_col(dy).cast("int"), as_col(axis).cast("int"), as_col(deg).cast("int"))


def shape_groups(height, width, channels, data) -> dict[tuple[int, int, int], list[int]]:
    """(h, w, c) -> the places of the images of that shape; those without pixels are left out."""
    groups: dict[tuple[int, int, int], list[int]] = {}
    for i, (h, w, c, d) in enumerate(zip(height, width, channels, data)):
        if isinstance(d, (bytes, bytearray)):
            groups.setdefault((int(h), int(w), int(c)), []).append(i)
    return groups


def stacked(data, shape: tuple[int, int, int], at: list[int]) -> np.ndarray:
    """The images at the given places as one (N, h, w, c) array."""
    return np.frombuffer(b"".join([data[i] for i in at]), dtype=np.uint8).reshape(len(at), *shape)


def _map_stacks(fn: Callable[[np.ndarray], np.ndarray]):
    """``fn`` takes and gives (N, h, w, c): one call for all images of a batch that have one shape."""

    @F.pandas_udf(IMAGE_STRUCT)
    def udf(img: pd.DataFrame) -> pd.DataFrame:
        n = len(img)
        heights, widths, chans, datas = [None] * n, [None] * n, [None] * n, [None] * n
        cols = [img[c].tolist() for c in ("height", "width", "nChannels", "data")]
        for shape, at in shape_groups(*cols).items():
            moved = np.ascontiguousarray(fn(stacked(cols[3], shape, at)).astype(np.uint8, copy=False))
            flat = moved.reshape(len(at), -1)
            for j, i in enumerate(at):
                heights[i], widths[i], chans[i], datas[i] = *moved.shape[1:], flat[j].tobytes()
        return _struct_frame(img["origin"].tolist(), heights, widths, chans, datas)

    return udf


def map_stacks(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], col: str = "SAMPLE", out_col: str | None = None) -> DataFrame:
    """Apply ``fn(ndarray (N, h, w, c) uint8) -> ndarray (N, h', w', c')`` to stacks of images of one shape."""
    return df.withColumn(out_col or col, _map_stacks(fn)(F.col(col)))


def map_images(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], col: str = "SAMPLE", out_col: str | None = None) -> DataFrame:
    """Apply any ``fn(ndarray (h,w,c) uint8) -> ndarray`` to every image; all images of one shape must give one shape."""

    def each(stack: np.ndarray) -> np.ndarray:
        out = np.stack([fn(a) for a in stack])
        return out[..., None] if out.ndim == 3 else out

    return map_stacks(df, each, col, out_col)


def _gray(a: np.ndarray) -> np.ndarray:
    if a.shape[-1] not in (3, 4):  # a fourth channel is transparency
        return a
    b, g, r = (a[..., i].astype(np.float64) for i in range(3))
    wb, wg, wr = GRAY_WEIGHTS_BGR
    return np.clip(np.rint(wb * b + wg * g + wr * r), 0, 255).astype(np.uint8)[..., None]


def _binary(a: np.ndarray, thresh: int = 128, maxval: int = 255) -> np.ndarray:
    return np.where(a > thresh, maxval, 0).astype(np.uint8)


def _bgr(a: np.ndarray) -> np.ndarray:
    return np.repeat(a, 3, axis=-1) if a.shape[-1] == 1 else a[..., :3]


def to_gray(df: DataFrame, col: str = "SAMPLE") -> DataFrame:
    """BGR and BGRA images -> 1 channel; other images unchanged."""
    return map_stacks(df, _gray, col)


def to_binary(df: DataFrame, col: str = "SAMPLE", thresh: int = 128, maxval: int = 255) -> DataFrame:
    """Gray first (binary implies gray), then pixel > thresh -> maxval else 0."""
    return map_stacks(df, lambda a: _binary(_gray(a), thresh, maxval), col)


def to_bgr(df: DataFrame, col: str = "SAMPLE") -> DataFrame:
    """Three channels whatever the file held: gray is repeated, transparency dropped."""
    return map_stacks(df, _bgr, col)


def resize_bilinear(a: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Bilinear resize with half-pixel centres (the common library default) of
    one image (h, w, c) or a stack of them (N, h, w, c)."""
    h, w = a.shape[-3:-1]
    if (h, w) == (out_h, out_w):
        return a
    ys = np.clip((np.arange(out_h) + 0.5) * (h / out_h) - 0.5, 0, h - 1)
    xs = np.clip((np.arange(out_w) + 0.5) * (w / out_w) - 0.5, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    f = a.astype(np.float64)
    upper, lower = f[..., y0, :, :], f[..., y1, :, :]
    top = upper[..., x0, :] * (1 - fx) + upper[..., x1, :] * fx
    bot = lower[..., x0, :] * (1 - fx) + lower[..., x1, :] * fx
    return np.clip(np.rint(top * (1 - fy) + bot * fy), 0, 255).astype(np.uint8)


def resize(df: DataFrame, out_h: int, out_w: int, col: str = "SAMPLE") -> DataFrame:
    return map_stacks(df, lambda a: resize_bilinear(a, out_h, out_w), col)


def expand_variants(df: DataFrame, col: str, shifts: Column, variants: Sequence[tuple[int, int, int]], out: str) -> DataFrame:
    """Each row once for every (translation, mirror axis, degrees) of ``variants``,
    with the image rotate(mirror(translate(img))) and the variant's index in ``out``.

    ``shifts`` is a list of structs (dx, dy) by translation. An image crosses to Python once;
    a batch's other columns are passed on as they are, once per variant."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])
    at = df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            img = batch.column(at)
            cols = [img.field(c).to_pylist() for c in ("height", "width", "nChannels", "data")]
            groups = {s: (i, stacked(cols[3], s, i)) for s, i in shape_groups(*cols).items()}
            moves = batch.column(batch.num_columns - 1)
            n = batch.num_rows
            for v, (vt, axis, deg) in enumerate(variants):
                heights, widths, datas = [None] * n, [None] * n, [None] * n
                for (h, w, _), (places, stack) in groups.items():
                    if (axis in (3, 4) or deg % 360) and h != w and h * w > 1:
                        raise ValueError(NOT_SQUARE.format(h, w))
                    move = moves[places[0]].as_py()[vt]  # depends on the shape alone
                    moved = np.ascontiguousarray(_geometry_stack(stack, move["dx"], move["dy"], axis, deg))
                    flat = moved.reshape(len(places), -1)
                    for j, i in enumerate(places):
                        heights[i], widths[i], datas[i] = moved.shape[1], moved.shape[2], flat[j].tobytes()
                made = {"height": pa.array(heights, pa.int32()), "width": pa.array(widths, pa.int32()), "data": pa.array(datas, pa.binary())}
                image = pa.StructArray.from_arrays([made.get(f.name, img.field(f.name)) for f in img.type], fields=list(img.type), mask=img.is_null())
                rest = [image if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([v] * n, pa.int32())], names=schema.names)

    return df.withColumn("_shifts", shifts).mapInArrow(run, schema)


def dataset_to_gray(df: DataFrame, col: str = "SAMPLE", state: dict | None = None) -> DataFrame:
    """Dataset-level gray conversion with the reference's state rules:
    refused after a binary conversion (``ValueError``)."""
    if state is not None:
        if state.get("binary"):
            raise ValueError("The images are binary by now; their grays are lost.")
        state["gray"] = True
    return to_gray(df, col)


def dataset_to_binary(df: DataFrame, col: str = "SAMPLE", state: dict | None = None) -> DataFrame:
    if state is not None:
        state["gray"] = state["binary"] = True
    return to_binary(df, col)


# ---- feature arrays ---------------------------------------------------------

@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(img: pd.DataFrame, scale: pd.Series) -> pd.Series:
    out = []
    cols = [img[c].tolist() for c in ("data",)] + [scale.tolist()]
    for d, k in zip(*cols):
        if not isinstance(d, (bytes, bytearray)):
            out.append(None)
            continue
        out.append(np.frombuffer(d, dtype=np.uint8).astype(np.float64) * float(k))
    return pd.Series(out)


def to_feature_vector(img, scale: float = 1.0) -> Column:
    """Image struct -> flat array<double> (h·w·c, row-major), times ``scale``
    (1/255 to rescale)."""
    return _features(as_col(img), F.lit(float(scale)))


# ---- validation -------------------------------------------------------------

def validation_reason(h, w, c, n_values) -> Column:
    """Why an image would be refused, or ``ok``: not_an_image (no pixels
    buffer), wrong_dimension (buffer size is not h·w·c), empty, one_dimensional
    (a single row or column), not_square."""
    h, w, c, n = as_col(h), as_col(w), as_col(c), as_col(n_values)
    return (
        F.when(n.isNull() | h.isNull() | w.isNull(), F.lit("not_an_image"))
        .when(h * w * c != n, F.lit("wrong_dimension"))
        .when(n == 0, F.lit("empty"))
        .when(((h == 1) | (w == 1)) & (h * w > 1), F.lit("one_dimensional"))
        .when(h != w, F.lit("not_square"))
        .otherwise(F.lit("ok"))
    )


def validate_images(df: DataFrame, col: str = "SAMPLE", mode: str = "report") -> DataFrame:
    """Data-quality pass over image structs. ``report``: reason counts;
    ``drop``: only valid rows; ``fail``: valid rows, error at the first bad one."""
    img = F.col(col)
    reason = validation_reason(img["height"], img["width"], img["nChannels"], F.length(img["data"]))
    if mode == "report":
        return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    if mode == "drop":
        return df.where(reason == "ok")
    if mode == "fail":
        return df.where(F.when(reason == "ok", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid image: "), reason))))
    raise ValueError(mode)


# ---- random augmentation ------------------------------------------------------

# Fixed values that must equal the reference's: augmentation ranges.
AUGMENT_RANGES = dict(rotation=30.0, shear=0.4, zoom=0.5)


def _unit(seed, key, epoch, salt: int) -> Column:
    """Uniform [0, 1) from 32 bits of an md5 — identical on every retry, and easily computed elsewhere."""
    return hash_order_key("", F.concat_ws(":", F.lit(str(seed)), as_col(epoch).cast("string"), F.lit(str(salt)), as_col(key).cast("string"))).cast("double") / F.lit(float(1 << 32))


def augment_params(key, epoch, seed: int = 0) -> Column:
    """Per (row, epoch) random parameters: rotation and shear in degrees, zoom, flips."""
    r = AUGMENT_RANGES
    return F.struct(
        ((_unit(seed, key, epoch, 1) * 2 - 1) * r["rotation"]).alias("theta"),
        ((_unit(seed, key, epoch, 2) * 2 - 1) * r["shear"]).alias("shear"),
        (1 - r["zoom"] + _unit(seed, key, epoch, 3) * 2 * r["zoom"]).alias("zx"),
        (1 - r["zoom"] + _unit(seed, key, epoch, 4) * 2 * r["zoom"]).alias("zy"),
        (_unit(seed, key, epoch, 5) < 0.5).alias("hflip"),
        (_unit(seed, key, epoch, 6) < 0.5).alias("vflip"),
    )


def warp_bilinear(stack: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Rotate, shear and zoom each image of a stack (N, h, w, c) about its
    centre, then flip it; a row of ``params`` is theta and shear in degrees, zoom of rows and
    columns, flip of columns, flip of rows. Gives floats.

    The three maps are composed to one from places of the result to places of
    the image; there the four neighbours are mixed by nearness. Places outside take the edge."""
    n, h, w, _ = stack.shape
    theta, shear = np.deg2rad(params[:, 0].astype(float)), np.deg2rad(params[:, 1].astype(float))
    zy, zx, hflip, vflip = params[:, 2].astype(float), params[:, 3].astype(float), params[:, 4].astype(bool), params[:, 5].astype(bool)
    m = np.stack([np.cos(theta) * zy, -np.sin(theta + shear) * zx, np.sin(theta) * zy, np.cos(theta + shear) * zx], axis=1)[:, :, None, None]
    rows, cols = np.arange(h, dtype=float), np.arange(w, dtype=float)
    y = np.where(vflip[:, None], rows[::-1], rows)[:, :, None] - (h - 1) / 2
    x = np.where(hflip[:, None], cols[::-1], cols)[:, None, :] - (w - 1) / 2
    sy = np.clip(m[:, 0] * y + m[:, 1] * x + (h - 1) / 2, 0, h - 1)
    sx = np.clip(m[:, 2] * y + m[:, 3] * x + (w - 1) / 2, 0, w - 1)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (sy - y0)[..., None], (sx - x0)[..., None]
    i = np.arange(n)[:, None, None]
    top = stack[i, y0, x0] * (1 - fx) + stack[i, y0, x1] * fx
    low = stack[i, y1, x0] * (1 - fx) + stack[i, y1, x1] * fx
    return top * (1 - fy) + low * fy


_PARAMS = ["theta", "shear", "zx", "zy", "hflip", "vflip"]


@F.pandas_udf(IMAGE_STRUCT)
def _augment_udf(img: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
    made = [[None] * len(img) for _ in range(4)]
    cols = [img[c].tolist() for c in ("height", "width", "nChannels", "data")]
    params = p[_PARAMS].to_numpy()
    for shape, at in shape_groups(*cols).items():
        moved = np.clip(np.rint(warp_bilinear(stacked(cols[3], shape, at), params[at])), 0, 255).astype(np.uint8)
        for j, i in enumerate(at):
            for out, value in zip(made, (*shape, moved[j].tobytes())):
                out[i] = value
    return _struct_frame(img["origin"].tolist(), *made)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _augment_features_udf(img: pd.DataFrame, p: pd.DataFrame, scale: pd.Series) -> pd.Series:
    out = [None] * len(img)
    cols = [img[c].tolist() for c in ("height", "width", "nChannels", "data")]
    params = p[_PARAMS].to_numpy()
    for shape, at in shape_groups(*cols).items():
        moved = warp_bilinear(stacked(cols[3], shape, at), params[at]) * scale.iloc[0]
        for j, i in enumerate(at):
            out[i] = moved[j].ravel()
    return pd.Series(out, dtype=object)


def random_augment(df: DataFrame, key: str, epoch, seed: int = 0, col: str = "SAMPLE") -> DataFrame:
    """Per-epoch random affine augmentation; parameters come from hashes of
    (seed, epoch, key), so a retried task produces the same images."""
    return df.withColumn(col, _augment_udf(F.col(col), augment_params(F.col(key), as_col(epoch), seed)))


def random_augment_features(df: DataFrame, key: str, epoch, seed: int = 0, col: str = "SAMPLE", out: str = "X", rescale: float = 1.0 / 255) -> DataFrame:
    """The same augmentation, given as flat numbers times ``rescale`` and not rounded to bytes."""
    return df.withColumn(out, _augment_features_udf(F.col(col), augment_params(F.col(key), as_col(epoch), seed), F.lit(float(rescale))))


@F.pandas_udf(IMAGE_STRUCT)
def _array_to_image(arr: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.DataFrame:
    n = len(arr)
    heights, widths, chans, datas = [None] * n, [None] * n, [None] * n, [None] * n
    for i, (a, hh, ww, cc) in enumerate(zip(arr.tolist(), h.tolist(), w.tolist(), c.tolist())):
        if a is None:
            continue
        img = np.clip(np.asarray(a, dtype=np.float64), 0, 255).astype(np.uint8)
        heights[i], widths[i], chans[i], datas[i] = int(hh), int(ww), int(cc), img.tobytes()
    return _struct_frame([None] * n, heights, widths, chans, datas)


def array_to_image(arr, h, w, c) -> Column:
    """Flat 0..255 numeric array + shape -> image struct (8-bit)."""
    return _array_to_image(as_col(arr).cast("array<double>"), as_col(h).cast("int"), as_col(w).cast("int"), as_col(c).cast("int"))


# ---- DataFrame-level geometric operators (array or struct images) -----------

def _geometry(df: DataFrame, image, axis=0, deg=0, dx=0, dy=0, turn_square: bool = True) -> DataFrame:
    from panelscope.operators.augment import _apply_pixels

    return _apply_pixels(
        df, image, F.lit(float(dx)), F.lit(float(dy)), F.lit(True), F.lit(True), F.lit(axis), F.lit(deg), "documented", turn_square=turn_square
    )


def mirror_images(df: DataFrame, image, axis: int) -> DataFrame:
    """Mirror every image: 1 rows reversed, 2 columns reversed, 3 main
    diagonal, 4 anti-diagonal (3 and 4 need square images)."""
    if axis not in (1, 2, 3, 4):
        raise ValueError(f"There is no mirror axis {axis}, only 1 to 4.")
    return _geometry(df, image, axis=axis)


def rotate_images(df: DataFrame, image, degrees: int, square: bool = False) -> DataFrame:
    """Counter-clockwise rotation by a multiple of 90 degrees; rows and columns
    of an image that isn't square change places. One-pixel and empty images pass unchanged."""
    if not isinstance(degrees, int) or isinstance(degrees, bool):
        raise TypeError(f"degrees is a whole number, not {type(degrees).__name__}.")
    if degrees % 90:
        raise ValueError(f"{degrees} degrees are no number of quarter turns.")
    return _geometry(df, image, deg=degrees % 360, turn_square=square)


def rotate_square_images(df: DataFrame, image, degrees: int) -> DataFrame:
    """``rotate_images`` that fails on an image that isn't square."""
    return rotate_images(df, image, degrees, square=True)


def translate_images(df: DataFrame, image, translation_x=0, translation_y=0, semantics: str = "documented") -> DataFrame:
    """Cyclic shift: fraction of the size (float) or pixels (int)."""
    from panelscope.functions import pixels as px
    from panelscope.operators.augment import _apply_pixels, _is_int

    px.check_translation(translation_x, semantics)
    px.check_translation(translation_y, semantics)
    px.check_image_column(df, image.col)
    return _apply_pixels(
        df, image, F.lit(float(translation_x)), F.lit(float(translation_y)), F.lit(_is_int(translation_x)),
        F.lit(_is_int(translation_y)), F.lit(0), F.lit(0), semantics, dataset_stage=False,
    )


def normalize_shape(df: DataFrame, channels_col: str = "SAMPLE_C") -> DataFrame:
    """h×w and h×w×1 are one shape: missing channel counts become 1 (image
    structs always carry ``nChannels``, so they need nothing)."""
    return df.withColumn(channels_col, F.coalesce(F.col(channels_col), F.lit(1)))
