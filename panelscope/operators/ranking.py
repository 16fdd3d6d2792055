"""Global row numbering without a single-partition sort.

``range_rank`` gives every row its 1-based position in a total order:

1. ``repartitionByRange`` on the whole order tuple, sorted within partitions,
   written once to the shared folder with each row's place in its partition.
   Because all keys take part in the bounds, a value of the first key that
   holds many rows (NULL, a busy date, a shared prefix) is cut by the next keys;
2. one row per partition with its row count; prefix sums of these (as many rows
   as partitions, whatever the data) are broadcast, and a row's position is its
   partition's offset plus its place.

Rows with the same tuple stay in one partition. If one tuple has more rows than
a partition's share (a sketch of the heaviest tuple tells), the rows are
written first with a number each, and that stored number is the last key. So
it is the same whenever a task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelscope.functions.util import as_col
from panelscope.session import shuffle_partitions, written

_ROW, _POS, _PART, _OFF, _N = "_rk_row", "_rk_pos", "_rk_part", "_rk_off", "_rk_n"
PLACE_BITS = 33  # of monotonically_increasing_id: the place within the partition
#: A tuple of fewer rows is never worth a pass of its own.
LEAST_HEAVY = 10_000


def has_heavy_tuple(df: DataFrame, names: Sequence[str], partitions: int, least: int = LEAST_HEAVY) -> bool:
    """Whether rows with one and the same tuple would overfill a partition; one aggregate over the keys alone."""
    cols = ", ".join(f"`{c}`" for c in names)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(xxhash64({cols}), 1)").alias("top")).first()
    most = max((t["count"] for t in r["top"] or ()), default=0)
    return most > max(r["n"] / partitions, least)


def numbered(parts: DataFrame, rank_col: str, total_col: str | None = None, pos: str = _POS) -> DataFrame:
    """``parts`` (written, with ``pos`` = monotonically_increasing_id) with each
    row's 1-based number in the order of partitions and places."""
    part, place = F.shiftright(pos, PLACE_BITS), F.col(pos).bitwiseAND((1 << PLACE_BITS) - 1)
    counts = parts.groupBy(part.alias(_PART)).agg(F.count(F.lit(1)).alias(_N))
    # one row per partition: its number bounds this window and the broadcast
    w = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PART, F.coalesce(F.sum(_N).over(w), F.lit(0)).alias(_OFF), F.sum(_N).over(Window.partitionBy(F.lit(1))).alias(_N))
    out = parts.withColumn(_PART, part).join(F.broadcast(offsets), _PART).withColumn(rank_col, F.col(_OFF) + place + 1)
    if total_col:
        out = out.withColumn(total_col, F.col(_N))
    return out.drop(_PART, _OFF, _N, pos)


def range_rank(
    df: DataFrame,
    order: Sequence[Column | str],
    rank_col: str = "rank",
    partitions: int | None = None,
    total_col: str | None = None,
    least_heavy: int = LEAST_HEAVY,
) -> DataFrame:
    """Add ``rank_col`` = row_number() over (order by ``order``), 1-based, and
    with ``total_col`` the number of rows. NULL keys come first; rows with equal
    tuples follow each other in any order. No rows: none."""
    n = partitions or shuffle_partitions(df.sparkSession)
    own = {f"_rk_k{i}": as_col(c) for i, c in enumerate(order) if not isinstance(c, str)}
    names = [c if isinstance(c, str) else f"_rk_k{i}" for i, c in enumerate(order)]
    keyed = df.withColumns(own) if own else df
    if has_heavy_tuple(keyed, names, n, least_heavy):
        keyed = written(keyed.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
        names.append(_ROW)
    ordered = keyed.repartitionByRange(n, *names).sortWithinPartitions(*names).drop(_ROW, *own)
    return numbered(written(ordered.withColumn(_POS, F.monotonically_increasing_id()), "ranked"), rank_col, total_col)


def hash_order_key(seed: int | str, *cols) -> Column:
    """Deterministic pseudo-random number in [0, 2^32) from ``md5(seed || key)``.

    The same under retries (unlike ``rand()``) and computable in DuckDB:
    ``('0x' || substr(md5(x), 1, 8))::BIGINT``."""
    key = F.concat(F.lit(str(seed)), *[as_col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
