"""Aggregates and guards. Each guard is one small aggregate; the lazy form
returns a one-row check frame, the eager form raises like the reference."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelscope.functions.ids import digits_order, id_digits
from panelscope.schema import KEY


def id_stats(df: DataFrame, key: str = KEY) -> DataFrame:
    """One row: ``max_id`` (largest first digit run as digits without leading
    zeros, of any length; '0' when empty), ``id_width`` (longest digit run),
    ``n_rows`` and ``n_without_digits``."""
    return id_stats_with(df, key)


def id_stats_with(df: DataFrame, key: str = KEY, *extra) -> DataFrame:
    """:func:`id_stats` plus extra aggregate columns, in the same single pass."""
    size, bare = digits_order("_d")
    largest = F.max(F.when(F.col("_d") != "", F.struct(size.alias("size"), bare.alias("digits"))))["digits"]
    return df.withColumn("_d", id_digits(F.col(key))).agg(
        F.coalesce(F.nullif(largest, F.lit("")), F.lit("0")).alias("max_id"),
        F.coalesce(F.max(F.length("_d")), F.lit(0)).cast("int").alias("id_width"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_d") == "").alias("n_without_digits"),
        *extra,
    )


def _require_digits(row) -> None:
    if row["n_without_digits"]:
        raise ValueError(
            f"{row['n_without_digits']} sample id(s) contain no digits, so no new id can be numbered after them."
        )


def max_sample_id(df: DataFrame, key: str = KEY) -> int:
    """The largest id number, however many digits it has; 0 for no rows."""
    row = id_stats(df, key).first()
    _require_digits(row)
    return int(row["max_id"])


def max_id_width(df: DataFrame, key: str = KEY) -> int:
    row = id_stats(df, key).first()
    _require_digits(row)
    return int(row["id_width"])


def observe_count(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Attach a row counter that is filled by the next action on the frame
    (no extra pass over the data)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a column (small result expected)."""
    return df.select(col).distinct().orderBy(col)


def distinct_count_report(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """One row: how many values ``col`` has, how many ``names`` there are, and whether these agree."""
    n = df.agg(F.count_distinct(col).alias("n_distinct"))
    return n.select("n_distinct", F.lit(len(names)).alias("n_names"), (F.col("n_distinct") == len(names)).alias("ok"))


def distinct_count_guard(df: DataFrame, col: str, names: Sequence[str]) -> None:
    """Refuse a column that hasn't one value for each name."""
    r = distinct_count_report(df, col, names).first()
    if not r["ok"]:
        raise ValueError(f"{col} has {r['n_distinct']} different values, but there are names for {r['n_names']}.")


def single_value_report(df: DataFrame, col: str = "TYPE") -> DataFrame:
    """One row: how many values ``col`` has, and the least of them."""
    return df.agg(F.count_distinct(col).alias("n_values"), F.min(col).alias("value"))


def single_value_guard(df: DataFrame, col: str = "TYPE") -> str:
    """The one value of a column; any other number of values is refused."""
    row = single_value_report(df, col).first()
    if row["n_values"] != 1:
        raise ValueError(f"Expected exactly one {col} value in the data, got {row['n_values']}.")
    return row["value"]


def distinct_shapes(df: DataFrame, h="height", w="width", c="nChannels", squeeze: bool = False) -> DataFrame:
    """Distinct (rows, cols, channels); ``squeeze`` folds h×w×1 into h×w
    (channels reported as NULL for single-channel shapes)."""
    ch = F.when(F.col(c) == 1, F.lit(None).cast("int")).otherwise(F.col(c)) if squeeze else F.col(c)
    return df.select(F.col(h).alias("rows"), F.col(w).alias("cols"), ch.alias("channels")).distinct()


def image_shape(df: DataFrame, h="height", w="width", c="nChannels") -> tuple[int, int]:
    """The one image shape (rows, cols); a mix of h×w and h×w×1 is squeezed
    first; more than one shape left -> ``ValueError``."""
    shapes = distinct_shapes(df, h, w, c).limit(64).collect()
    if len(shapes) > 1:
        shapes = distinct_shapes(df, h, w, c, squeeze=True).limit(64).collect()
    if len(shapes) > 1:
        raise ValueError(f"A model takes images of one shape, but these have {len(shapes)} or more: {', '.join(repr(tuple(s)) for s in shapes)}.")
    if not shapes:
        raise ValueError("No images.")
    return int(shapes[0]["rows"]), int(shapes[0]["cols"])


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: OLS slope, intercept, r², n of ``y ~ x`` (single aggregate)."""
    return df.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
        F.regr_count(F.col(y), F.col(x)).alias("n"),
    )


def rmse_of(y: str, pred: str) -> Column:
    """Root of the mean squared residual, as an aggregate expression."""
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(pred), 2)))


def rmse(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(rmse_of(y, pred).alias("rmse"))


def residual_hist(df: DataFrame, residual: str, lo: float, hi: float, n_bins: int) -> DataFrame:
    """Counts per equal-width bin of the residual (``width_bucket``: 0 below
    ``lo``, ``n_bins+1`` at or above ``hi``)."""
    b = F.expr(f"width_bucket(`{residual}`, {float(lo)}, {float(hi)}, {int(n_bins)})")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Cells of the grid on which a density is computed, and what it reaches beyond the data, in bandwidths.
CELLS, REACH = 512, 3
MOST_BINS = 50


@dataclass
class Distribution:
    """A histogram (``bin`` from 0, ``lo``, ``hi``, ``n``) and a density (``x``, ``density``) of one column."""

    histogram: DataFrame
    density: DataFrame
    n: int
    bandwidth: float


def distribution(df: DataFrame, col: str, cells: int = CELLS, most_bins: int = MOST_BINS, accuracy: int = 100_000) -> Distribution:
    """Histogram with automatic bins and Gaussian kernel density of a column.

    Pass 1 takes extremes, moments and the quartiles (from a mergeable sketch of relative
    rank error 1/``accuracy``): bin width 2 IQR / n^(1/3), at most ``most_bins`` bins, sqrt(n)
    bins where the quartiles are equal; bandwidth s / n^(1/5). Pass 2 counts bins and gives each
    value to its two neighbouring cells of a grid by nearness (linear
    binning). The kernel is then applied to the cells, whose number is fixed.
    Against the kernel applied to every value the density is off by at most
    0.05 (cell width / bandwidth)^2 of the kernel's peak. NULL and NaN don't count; no values: no rows."""
    spark = df.sparkSession
    v = df.select(F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    s = v.agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("s"),
        F.percentile_approx("v", [0.25, 0.75], accuracy).alias("q"),
    ).first()
    hist_schema, dens_schema = "bin int, lo double, hi double, n bigint", "x double, density double"
    n, lo, hi = s["n"], s["lo"], s["hi"]
    if not n:
        return Distribution(spark.createDataFrame([], hist_schema), spark.createDataFrame([], dens_schema), 0, 0.0)
    if lo == hi:  # as for a histogram of one value: a bin around it, and no density
        one = spark.createDataFrame([(0, lo - 0.5, hi + 0.5, n)], hist_schema)
        return Distribution(one, spark.createDataFrame([], dens_schema), n, 0.0)
    width = 2 * (s["q"][1] - s["q"][0]) / n ** (1 / 3)
    bins = min(most_bins, max(1, math.ceil((hi - lo) / width) if width > 0 else int(math.sqrt(n))))
    band = s["s"] * n ** (-1 / 5)
    start = lo - REACH * band
    step = (hi + REACH * band - start) / (cells - 1)
    place = (F.col("v") - F.lit(start)) / F.lit(step)
    cell = F.floor(place).cast("int")
    at = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int"), F.lit(bins - 1))
    # at most cells + bins rows, since bins and cells follow the same order
    rows = v.select(at.alias("bin"), cell.alias("cell"), (place - F.floor(place)).alias("f")).groupBy("bin", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f")).collect()
    counts, mass = np.zeros(bins, np.int64), np.zeros(cells + 1)
    for r in rows:
        counts[r["bin"]] += r["n"]
        mass[r["cell"]] += r["n"] - r["f"]
        mass[r["cell"] + 1] += r["f"]
    x = start + step * np.arange(cells)
    away = step * (np.arange(cells)[:, None] - np.arange(cells)) / band
    density = np.exp(-0.5 * away**2) @ mass[:cells] / (n * band * math.sqrt(2 * math.pi))
    edge = lambda i: lo + (hi - lo) * i / bins
    hist = [(i, edge(i), edge(i + 1), int(c)) for i, c in enumerate(counts)]
    return Distribution(spark.createDataFrame(hist, hist_schema), spark.createDataFrame(list(zip(x.tolist(), density.tolist())), dens_schema), n, band)


def accuracy_and_loss(df: DataFrame, probs: str, label: str, pred: str | None = None) -> DataFrame:
    """Accuracy (argmax == label) and mean sparse categorical cross-entropy."""
    p = F.col(probs)
    pred_c = F.col(pred) if pred else (F.array_position(p, F.array_max(p)) - 1)
    return df.agg(
        F.avg((pred_c == F.col(label)).cast("double")).alias("accuracy"),
        F.avg(-F.log(F.get(p, F.col(label).cast("int")).cast("double"))).alias("loss"),
    )
