"""Pixel operators on images held as flat, row-major numeric arrays.

An image is ``arr`` (array of numbers, length ``h*w*c``) with its shape as
``h``, ``w``, ``c`` (ints or Columns). Every geometric operator is an index
permutation: output pixel ``(r, q)`` reads input pixel ``src(r, q)``. The
permutation is one ``transform(sequence(...), k -> arr[src(k)])`` — a single
narrow pass inside the JVM, no Python and no shuffle. Several operators are
composed into one permutation so an amplified row is built in one pass.

For image structs (bytes from ``format("image")``) see
:mod:`panelscope.operators.images`, which runs the same maps in numpy.
"""

from __future__ import annotations

import math
import numbers

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelscope.functions.util import as_col

# Fixed values that must equal the reference's for the same results.
# Float translations are accepted up to 1.0 plus this tolerance (observed mode).
TRANSLATION_TOLERANCE = 0.5
MIRROR_AXES = (1, 2, 3, 4)
ROTATIONS = (0, 90, 180, 270)


def _when_chain(key: Column, cases: dict, default):
    out = None
    for k, v in cases.items():
        out = F.when(key == F.lit(k), v) if out is None else out.when(key == F.lit(k), v)
    return out.otherwise(default)


def check_image_column(df, col: str) -> str:
    """``"array"`` for a numeric array column, ``"struct"`` for an image
    struct; anything else is a ``TypeError`` (the reference refuses non-arrays)."""
    from pyspark.sql import types as T

    if col not in df.columns:
        raise TypeError(f"No image column {col!r}.")
    dt = df.schema[col].dataType
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.NumericType):
        return "array"
    if isinstance(dt, T.StructType) and {"height", "width", "nChannels", "data"} <= set(dt.fieldNames()):
        return "struct"
    raise TypeError(f"Image must be a numeric array or an image struct, got {dt.simpleString()}.")


# ---- source maps: (r, q) of the output -> (r', q') of the input (h x w) ----

def mirror_src(axis, r, q, h, w):
    """Mirror axes: 1 rows reversed, 2 columns reversed, 3 main diagonal, 4 anti-diagonal."""
    if isinstance(axis, int):
        return {
            0: (r, q),
            1: (h - 1 - r, q),
            2: (r, w - 1 - q),
            3: (q, r),
            4: (h - 1 - q, w - 1 - r),
        }[axis]
    a = as_col(axis)
    srcs = {ax: mirror_src(ax, r, q, h, w) for ax in MIRROR_AXES}
    return (
        _when_chain(a, {ax: s[0] for ax, s in srcs.items()}, r),
        _when_chain(a, {ax: s[1] for ax, s in srcs.items()}, q),
    )


def mirror_shape(axis, h, w):
    if isinstance(axis, int):
        return (w, h) if axis in (3, 4) else (h, w)
    swap = as_col(axis).isin(3, 4)
    return F.when(swap, w).otherwise(h), F.when(swap, h).otherwise(w)


def rotate_src(deg, r, q, h, w):
    """Counter-clockwise rotation by 0/90/180/270 degrees (``np.rot90``)."""
    if isinstance(deg, int):
        return {
            0: (r, q),
            90: (q, w - 1 - r),
            180: (h - 1 - r, w - 1 - q),
            270: (h - 1 - q, r),
        }[deg % 360]
    d = F.pmod(as_col(deg), F.lit(360))
    srcs = {a: rotate_src(a, r, q, h, w) for a in (90, 180, 270)}
    return (
        _when_chain(d, {a: s[0] for a, s in srcs.items()}, r),
        _when_chain(d, {a: s[1] for a, s in srcs.items()}, q),
    )


def rotate_shape(deg, h, w):
    if isinstance(deg, int):
        return (w, h) if deg % 180 == 90 else (h, w)
    swap = F.pmod(as_col(deg), F.lit(180)) == 90
    return F.when(swap, w).otherwise(h), F.when(swap, h).otherwise(w)


def translate_src(dx, dy, r, q, h, w):
    """Cyclic roll: content moves ``dy`` rows down and ``dx`` columns right."""
    return F.pmod(r - as_col(dy), h), F.pmod(q - as_col(dx), w)


# ---- building the permutation ---------------------------------------------

def permute(arr, h, w, c, src_fn, out_shape=None) -> Column:
    """Apply a source map. ``src_fn(r, q, h, w) -> (r', q')`` in input coords;
    ``out_shape`` = (ho, wo) of the result (default: same as input)."""
    arr, h, w, c = as_col(arr), as_col(h), as_col(w), as_col(c)
    ho, wo = out_shape if out_shape is not None else (h, w)
    ho, wo = as_col(ho), as_col(wo)
    n = ho * wo * c

    def pick(k):
        p = ((k - F.pmod(k, c)) / c).cast("int")
        ch = F.pmod(k, c)
        r = (p - F.pmod(p, wo)) / wo
        r = r.cast("int")
        q = F.pmod(p, wo)
        sr, sq = src_fn(r, q, h, w)
        return F.get(arr, ((sr * w + sq) * c + ch).cast("int"))

    return F.when(n <= 0, arr).otherwise(F.transform(F.sequence(F.lit(0), n - 1), pick))


def mirror(arr, axis, h, w, c=1) -> Column:
    return permute(arr, h, w, c, lambda r, q, hh, ww: mirror_src(axis, r, q, hh, ww), mirror_shape(axis, as_col(h), as_col(w)))


def rotate(arr, degrees, h, w, c=1) -> Column:
    if isinstance(degrees, int) and degrees % 90 != 0:
        raise ValueError(f"{degrees} degrees are no number of quarter turns.")
    return permute(arr, h, w, c, lambda r, q, hh, ww: rotate_src(degrees, r, q, hh, ww), rotate_shape(degrees, as_col(h), as_col(w)))


def translate_px(arr, dx, dy, h, w, c=1) -> Column:
    return permute(arr, h, w, c, lambda r, q, hh, ww: translate_src(dx, dy, r, q, hh, ww))


# ---- translation values ----------------------------------------------------

def check_translation(t, semantics: str = "documented") -> None:
    """Python-level validation of one translation value (plan time)."""
    if isinstance(t, bool) or not isinstance(t, numbers.Real):
        raise TypeError(f"A translation is a share (float) or pixels (int), not {type(t).__name__}.")
    if isinstance(t, numbers.Integral):
        return
    limit = 1.0 + (TRANSLATION_TOLERANCE if semantics == "observed" else 0.0)
    if not (-limit <= float(t) <= limit) or math.isnan(float(t)):
        raise ValueError(f"A share of the image lies between -{limit:g} and {limit:g}; {t!r} does not.")


def shift_pixels(t, size, is_int) -> Column:
    """Pixels to roll for translation ``t`` over an axis of ``size`` pixels:
    fraction -> ``round_half_even(size*t) mod size``; integer -> ``t mod size``."""
    t, size = as_col(t), as_col(size)
    frac = F.pmod(F.bround(size.cast("double") * t.cast("double"), 0).cast("int"), size)
    whole = F.pmod(t.cast("long"), size.cast("long")).cast("int")
    if isinstance(is_int, bool):
        return whole if is_int else frac
    return F.when(as_col(is_int), whole).otherwise(frac)


def translation_shifts(tx, ty, tx_int, ty_int, h, w, semantics: str = "documented"):
    """(dx, dy) pixel shifts (columns right, rows down) for one translation.

    documented: x moves columns by a share of the width, y rows by a share of
    the height. observed: x rolls rows by a share of the *width*, y rolls
    columns by a share of the height (an integer y is taken mod the width),
    and when both values are in {0, 1, -1} nothing moves."""
    tx, ty, tx_int, ty_int = as_col(tx), as_col(ty), as_col(tx_int), as_col(ty_int)
    h, w = as_col(h), as_col(w)
    if semantics == "documented":
        return shift_pixels(tx, w, tx_int), shift_pixels(ty, h, ty_int)
    rows = shift_pixels(tx, w, tx_int)
    cols = F.when(ty_int, F.pmod(ty.cast("long"), w.cast("long")).cast("int")).otherwise(shift_pixels(ty, h, False))
    still = tx.isin(0, 1, -1) & ty.isin(0, 1, -1)
    return F.when(still, F.lit(0)).otherwise(cols), F.when(still, F.lit(0)).otherwise(rows)


# ---- intensity operators on arrays ----------------------------------------

def to_binary(arr, threshold: float = 128, maxval: float = 255) -> Column:
    """Strict threshold: value > threshold -> maxval, else 0."""
    return F.transform(as_col(arr), lambda x: F.when(x > F.lit(threshold), F.lit(maxval)).otherwise(F.lit(0)).cast("double"))


def to_gray(arr, c) -> Column:
    """3-channel BGR flat array -> 1 channel: round(.114 B + .587 G + .299 R).
    Arrays that do not have 3 channels are returned unchanged."""
    a = as_col(arr)
    n = (F.size(a) / as_col(c)).cast("int")
    gray = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda p: F.bround(
            F.lit(0.114) * F.get(a, p * 3) + F.lit(0.587) * F.get(a, p * 3 + 1) + F.lit(0.299) * F.get(a, p * 3 + 2),
            0,
        ),
    )
    return F.when((as_col(c) == 3) & (n > 0), gray).otherwise(a)


# ---- composed maps as per-row affine coefficients ---------------------------
# Every mirror and 90° rotation maps output (r, q) to input (r', q') by an
# integer 2×2 matrix plus an offset; composing them is a matrix product that
# is evaluated once per row (outside the per-pixel lambda). The per-pixel work
# is then two dot products, the cyclic shift and one array read.

def _mat(cases: dict, key: Column, default):
    """when-chain over ``key`` picking one of several (a11,a12,a21,a22,t1,t2)."""
    out = []
    for j in range(6):
        expr = None
        for k, v in cases.items():
            expr = F.when(key == F.lit(k), v[j]) if expr is None else expr.when(key == F.lit(k), v[j])
        out.append(expr.otherwise(default[j]) if expr is not None else default[j])
    return out


def rotate_affine(deg, h, w):
    """(a11, a12, a21, a22, t1, t2) of the rotation source map; (h, w) = input dims."""
    one, zero = F.lit(1), F.lit(0)
    cases = {
        90: (zero, one, -one, zero, zero, w - 1),
        180: (-one, zero, zero, -one, h - 1, w - 1),
        270: (zero, -one, one, zero, h - 1, zero),
    }
    ident = (one, zero, zero, one, zero, zero)
    return _mat(cases, F.pmod(as_col(deg), F.lit(360)), ident)


def mirror_affine(axis, h, w):
    one, zero = F.lit(1), F.lit(0)
    cases = {
        1: (-one, zero, zero, one, h - 1, zero),
        2: (one, zero, zero, -one, zero, w - 1),
        3: (zero, one, one, zero, zero, zero),
        4: (zero, -one, -one, zero, h - 1, w - 1),
    }
    ident = (one, zero, zero, one, zero, zero)
    return _mat(cases, as_col(axis), ident)


def compose_affine(outer, inner):
    """Source map of applying ``outer``'s source map first, then ``inner``'s:
    p_in = inner(outer(p))."""
    a11, a12, a21, a22, t1, t2 = outer
    b11, b12, b21, b22, u1, u2 = inner
    return (
        b11 * a11 + b12 * a21,
        b11 * a12 + b12 * a22,
        b21 * a11 + b22 * a21,
        b21 * a12 + b22 * a22,
        b11 * t1 + b12 * t2 + u1,
        b21 * t1 + b22 * t2 + u2,
    )


AFFINE_COLS = ("_px_a11", "_px_a12", "_px_a21", "_px_a22", "_px_t1", "_px_t2", "_px_dy", "_px_dx", "_px_ho", "_px_wo")


def geometry_columns(h, w, axis=0, deg=0, dx=0, dy=0) -> dict:
    """Per-row columns describing rotate(mirror(translate(img)))."""
    h, w = as_col(h), as_col(w)
    h2, w2 = mirror_shape(axis, h, w) if not isinstance(axis, int) or axis else (h, w)
    ho, wo = rotate_shape(deg, h2, w2) if not isinstance(deg, int) or deg else (h2, w2)
    rot = rotate_affine(deg, h2, w2)
    mir = mirror_affine(axis, h, w)
    m = compose_affine(rot, mir)
    vals = (*m, as_col(dy), as_col(dx), ho, wo)
    return {name: v.cast("int") for name, v in zip(AFFINE_COLS, vals)}


def permute_affine(arr, h, w, c) -> Column:
    """Apply the map held in the ``geometry_columns`` of the row. With
    ``c == 1`` known at plan time the channel arithmetic is left out."""
    single = isinstance(c, int) and c == 1
    arr, h, w, c = as_col(arr), as_col(h), as_col(w), as_col(c)
    a11, a12, a21, a22, t1, t2, dy, dx, ho, wo = (F.col(n) for n in AFFINE_COLS)
    n = ho * wo * c

    def pick(k):
        if single:
            q = F.pmod(k, wo)
            r = ((k - q) / wo).cast("int")
            sr = F.pmod(a11 * r + a12 * q + t1 - dy, h)
            sq = F.pmod(a21 * r + a22 * q + t2 - dx, w)
            return F.get(arr, sr * w + sq)
        ch = F.pmod(k, c)
        p = ((k - ch) / c).cast("int")
        q = F.pmod(p, wo)
        r = ((p - q) / wo).cast("int")
        sr = F.pmod(a11 * r + a12 * q + t1 - dy, h)
        sq = F.pmod(a21 * r + a22 * q + t2 - dx, w)
        return F.get(arr, (sr * w + sq) * c + ch)

    return F.when(n <= 0, arr).otherwise(F.transform(F.sequence(F.lit(0), n - 1), pick))
