"""Scalar and array expressions used around labels, predictions and fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelscope.functions.util import as_col

# Fixed values that must equal the reference's for the same results.
LABEL_NAMES = ("pass", "minor_damage", "major_damage", "fail")
LABEL_EDGES = (-0.1, 0.25, 0.5, 0.75, 1.1)
ISCLOSE_RTOL = 1e-5
ISCLOSE_ATOL = 1e-8
REVIEW_THRESHOLD = 0.01


def _check_bins(edges: Sequence[float], names: Sequence[str]) -> None:
    if len(edges) != len(names) + 1:
        raise ValueError(f"{len(names)} names need {len(names) + 1} edges, not {len(edges)}.")
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("Bin edges must increase monotonically.")


def bin_label(c, edges: Sequence[float] = LABEL_EDGES, names: Sequence[str] = LABEL_NAMES) -> Column:
    """Right-closed bins ``(a, b]`` -> name; outside (or NULL/NaN) -> NULL."""
    _check_bins(edges, names)
    x = as_col(c)
    out = None
    for lo, hi, name in zip(edges, edges[1:], names):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi)) & ~F.isnan(x)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def bin_code(c, edges: Sequence[float] = LABEL_EDGES) -> Column:
    """0-based index of the right-closed bin; NULL outside."""
    x = as_col(c)
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi)) & ~F.isnan(x)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def round_half_even(c, scale: int = 0) -> Column:
    return F.bround(as_col(c), scale)


def floor_mod(a, b) -> Column:
    """Python ``%``: result has the sign of the divisor."""
    return F.pmod(as_col(a), as_col(b))


def isclose(a, b, rtol: float = ISCLOSE_RTOL, atol: float = ISCLOSE_ATOL) -> Column:
    a, b = as_col(a), as_col(b)
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def gt_threshold(c, threshold: float = REVIEW_THRESHOLD) -> Column:
    return F.coalesce(as_col(c) > F.lit(threshold), F.lit(False))


def rescale(arr, factor: float = 1.0 / 255.0) -> Column:
    return F.transform(as_col(arr), lambda x: x.cast("double") * F.lit(factor))


def softmax(arr) -> Column:
    """Max-shifted softmax over an array of logits."""
    # each value is bound by a lambda over a list of one, so that the logits, their
    # maximum and the sum are computed once a row and not once an element
    logits = F.array(F.transform(as_col(arr), lambda x: x.cast("double")))
    top = F.transform(logits, lambda a: F.struct(a.alias("a"), F.array_max(a).alias("m")))
    powers = F.transform(top, lambda t: F.transform(t["a"], lambda x: F.exp(x - t["m"])))
    summed = F.transform(powers, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x).alias("s")))
    return F.get(F.transform(summed, lambda t: F.transform(t["e"], lambda x: x / t["s"])), 0)


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    a = as_col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def max_conf(arr) -> Column:
    """Confidence in percent: 100 * max probability."""
    return F.array_max(as_col(arr)).cast("double") * F.lit(100.0)


def is_correct(pred, label) -> Column:
    return as_col(pred) == as_col(label)


def predict_line(x, slope, intercept) -> Column:
    return as_col(slope) * as_col(x) + as_col(intercept)


def one_hot(index, n_classes: int) -> Column:
    """array<int> of length ``n_classes`` with a 1 at ``index``."""
    i = as_col(index)
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: (k == i).cast("int"))
