"""Filters, predicates and the filtered-dataset wrapper."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.functions.scalars import gt_threshold, isclose
from panelscope.functions.util import as_col

# Fixed value that must equal the reference's: the default predicate keeps
# one panel type.
DEFAULT_FILTER = "TYPE == 'poly'"


def filter_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Keep rows matching a Spark SQL predicate (text or Column).

    A predicate that does not parse or resolve raises ``ValueError`` naming it,
    at call time (analysis is eager), not at the first action."""
    try:
        cond = F.expr(predicate) if isinstance(predicate, str) else predicate
        out = df.filter(cond)
        out.schema  # force analysis now
        return out
    except (AnalysisException, ParseException) as err:
        raise ValueError(f"Filter query {predicate!r} could not be applied: {err}") from err


def not_equal_keep_missing(a, b) -> Column:
    """pandas ``a != b`` (missing values compare unequal, so they are kept)."""
    return ~as_col(a).eqNullSafe(as_col(b))


def unaugmented_only(df: DataFrame, stage: str = "all") -> DataFrame:
    """Rows not yet touched by a stage: translate / mirror / rotate / all."""
    conds = {
        "translate": (F.col("TRANSL_X") == 0) & (F.col("TRANSL_Y") == 0),
        "mirror": F.col("MIRROR_AXIS") == 0,
        "rotate": F.col("ROT_DEG") == 0,
    }
    if stage == "all":
        return df.filter(conds["translate"] & conds["mirror"] & conds["rotate"])
    return df.filter(conds[stage])


def label_eq(df: DataFrame, label: str, col: str = "LABEL_CATEGORY") -> DataFrame:
    return df.filter(F.col(col) == F.lit(label))


def label_prefix(df: DataFrame, pattern: str, col: str = "LABEL_CATEGORY") -> DataFrame:
    """Regex match at the start of the value (``str.match``)."""
    return df.filter(F.col(col).rlike(f"^(?:{pattern})"))


def data_by_label(df: DataFrame, prob_col: str = "PROBABILITY", tolerance: float = 1e-8) -> DataFrame:
    """Three overlapping sets in one pass: ``prob_one`` (≈1), ``prob_positive``
    (> 0.01, includes ≈1) and ``prob_zero`` (≈0). One output row per
    (input row, set it belongs to), set name in ``label_set``."""
    p = F.col(prob_col)
    sets = F.filter(
        F.array(
            F.when(isclose(p, F.lit(1.0), atol=tolerance), F.lit("prob_one")),
            F.when(gt_threshold(p), F.lit("prob_positive")),
            F.when(isclose(p, F.lit(0.0), atol=tolerance), F.lit("prob_zero")),
        ),
        lambda s: s.isNotNull(),
    )
    return df.select("*", F.explode(sets).alias("label_set"))


@dataclass
class Dataset:
    """Original and current (filtered / amplified) data of a labelled dataset."""

    original: DataFrame
    current: DataFrame = field(default=None)  # type: ignore[assignment]

    def __post_init__(self):
        if self.current is None:
            self.current = self.original

    def filter(self, predicate: str | Column) -> "Dataset":
        """Cumulative: applies to the current (already filtered) data."""
        self.current = filter_rows(self.current, predicate)
        return self

    def reset(self) -> "Dataset":
        self.current = self.original
        return self
