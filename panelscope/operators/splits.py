"""Exact, repeatable splits, shuffles and batches.

Randomness comes from hashes of (seed, key) so a retried task draws the same
rows (``rand()`` would not). An exact split needs no ranking: the k-th smallest
hash is found by counting (see ``kth_hash``), and each row is then compared
with it where it lies. Shuffles and batches are numbered by ``range_rank``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.functions.util import as_col
from panelscope.operators.ranking import hash_order_key, numbered, range_rank
from panelscope.operators.setops import duplicated_keys
from panelscope.schema import KEY
from panelscope.session import written

_H, _T, _R, _N, _K, _POS = "_sp_h", "_sp_t", "_sp_rank", "_sp_n", "_sp_key", "_sp_pos"
DIGIT = 16  # bits of a digit of the hash: 65,536 counts at most reach the driver


def _row_hash(df: DataFrame, seed) -> Column:
    """64-bit hash of the whole row: breaks ties between rows sharing a key."""
    return F.xxhash64(F.lit(str(seed)), *[F.col(c) for c in df.columns])


def hash_rank(df: DataFrame, key: str, seed, rank_col: str = _R, total_col: str | None = _N) -> DataFrame:
    """Rank rows by ``md5(seed || key)`` (then a row hash): a seeded shuffle."""
    keyed = df.withColumn(_H, hash_order_key(seed, key)).withColumn(_T, _row_hash(df, seed))
    return range_rank(keyed, [_H, key, _T], rank_col=rank_col, total_col=total_col).drop(_H, _T)


def train_size(n: int, train_frac: float, test_size: float | None = None) -> int:
    """``round(train_frac * n)`` (half to even), or what ``ceil(test_size * n)`` leaves."""
    if test_size is None:
        return round(n * train_frac)
    return n - -int(-(n * float(test_size)) // 1)


@dataclass
class Cut:
    """A hash value and how many of its ``count`` rows are among the first k."""

    value: int
    taken: int
    count: int


def kth_hash(hashes: DataFrame, col: str, k: int, bits: int) -> Cut:
    """Where the ``k`` smallest (k >= 1) of a column of whole numbers end, by one
    count per digit: the first over all rows, the next over those in the one
    cell that the k-th row is in. The highest digit may be signed."""
    inside, left = hashes, k
    value = count = 0
    for shift in range(bits - DIGIT, -1, -DIGIT):
        digit = F.shiftright(col, shift)
        if shift + DIGIT < bits:
            digit = digit.bitwiseAND((1 << DIGIT) - 1)
        for d, count in sorted(inside.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if left <= count:
                break
            left -= count
        value = (value << DIGIT) + d
        inside = inside.where(F.shiftright(col, shift) == value)
    return Cut(value, left, count)


def split_exact(
    df: DataFrame,
    train_frac: float = 0.65,
    key: str = KEY,
    seed: int | str = 0,
    split_col: str = "split",
    test_size: float | None = None,
    drop_repeated: bool = True,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Train = exactly ``round(frac * n)`` rows drawn by hash order; test =
    the other rows, but rows whose key is repeated in the data are dropped
    from the test part (a key must not be in both parts);
    ``drop_repeated=False`` keeps them.

    With ``test_size`` the test part is sized ``ceil(test_size * n)`` instead
    (the 80/20 split of the regression demo).

    ``df`` is evaluated twice: once for its keys, whose hashes are written and
    counted, and once to compare each row with the cut. Rows that share the hash at
    the cut are ordered by key, then by a hash of the whole row, for which the
    rows of that hash alone are read once more. Rows equal in all of that are dealt
    by number, so that none is lost and the sizes stay exact.

    ``keys`` is a cheaper frame of the same keys (say, without pixels): it is
    hashed and counted instead, and ``df`` is only compared."""
    if not 0.0 <= train_frac <= 1.0:
        raise ValueError(f"train_frac must be within [0, 1], got {train_frac}.")
    h = F.coalesce(hash_order_key(seed, key), F.lit(0))
    keys = written((df if keys is None else keys).select(F.col(key), h.alias(_H)), "split-keys")
    n = keys.count()
    out = _first(df, key, keys, h, n, train_size(n, train_frac, test_size), seed, split_col)
    if drop_repeated:
        repeated = written(duplicated_keys(keys, key).withColumnRenamed(key, _K), "split-repeated")
        if not repeated.isEmpty():
            return out.join(repeated, (F.col(split_col) == "test") & F.col(key).eqNullSafe(F.col(_K)), "left_anti")
    return out


def _first(df: DataFrame, key: str, keys: DataFrame, h: Column, n: int, k: int, seed, split_col: str) -> DataFrame:
    """``df`` with ``split_col``: train for the first ``k`` of its ``n`` rows by (hash, key, row hash), test for the others."""
    deal = lambda is_train: F.when(is_train, F.lit("train")).otherwise(F.lit("test"))
    if k <= 0 or k >= n:
        return df.withColumn(split_col, F.lit("train" if k > 0 else "test"))
    cut = kth_hash(keys, _H, k, 32)
    if cut.taken == cut.count:
        return df.withColumn(split_col, deal(h <= cut.value))
    # the keys that share one 32-bit hash are few, whatever each one's rows
    left = cut.taken
    for c, count in keys.where(F.col(_H) == cut.value).groupBy(key).agg(F.count(F.lit(1))).orderBy(key).collect():
        if left <= count:
            break
        left -= count
    here = F.lit(c).cast(df.schema[key].dataType)
    lower = F.col(key).isNull() | (F.col(key) < here) if c is not None else F.lit(False)
    before, same = (h < cut.value) | ((h == cut.value) & lower), (h == cut.value) & F.col(key).eqNullSafe(here)
    if left == count:
        return df.withColumn(split_col, deal(before | same))
    t = _row_hash(df, seed)
    edge = kth_hash(written(df.where(same).select(t.alias(_T)), "split-ties"), _T, left, 64)
    if edge.taken == edge.count:
        return df.withColumn(split_col, deal(before | (same & (t <= edge.value))))
    # equal rows on both sides of the cut: numbered, and the first ones train
    marked = written(df.withColumn(split_col, F.when(before | (same & (t < edge.value)), F.lit("train")).when(same & (t == edge.value), F.lit("edge")).otherwise(F.lit("test"))), "split-marked")
    equal = written(marked.where(F.col(split_col) == "edge").withColumn(_POS, F.monotonically_increasing_id()), "split-equal")
    dealt = numbered(equal, _R, pos=_POS).withColumn(split_col, deal(F.col(_R) <= edge.taken)).drop(_R)
    return marked.where(F.col(split_col) != "edge").unionByName(dealt)


def split_80_20(df: DataFrame, key: str = KEY, seed: int | str = 42, split_col: str = "split") -> DataFrame:
    """Four fifths train, the other rows test; every row is in one part, repeated keys and equal rows too."""
    return split_exact(df, 0.8, key, seed, split_col, test_size=0.2, drop_repeated=False)


def split_counts(split_df: DataFrame, original: DataFrame, split_col: str = "split") -> DataFrame:
    """One-row check frame: train, test and original sizes and whether they add up."""
    parts = split_df.select(F.col(split_col).alias("_s")).unionByName(original.select(F.lit(None).cast("string").alias("_s")))
    out = parts.agg(
        F.count_if(F.col("_s") == "train").alias("n_train"),
        F.count_if(F.col("_s") == "test").alias("n_test"),
        F.count_if(F.col("_s").isNull()).alias("n_data"),
    )
    return out.withColumn("conserved", (F.col("n_train") + F.col("n_test")) == F.col("n_data"))


def split_conserves_rows(split_df: DataFrame, original: DataFrame, split_col: str = "split") -> None:
    row = split_counts(split_df, original, split_col).first()
    if not row["conserved"]:
        raise RuntimeError("train and test rows do not add up to the rows that were split")


def split_tail(df: DataFrame, order, validation_split: float = 0.3, split_col: str = "split") -> DataFrame:
    """Last ``validation_split`` share in row order -> ``validation``; train =
    the first ``floor(n * (1 - validation_split))`` rows."""
    r = range_rank(df, [as_col(c) for c in order], _R, total_col=_N)
    cut = F.floor(F.col(_N).cast("double") * F.lit(1.0 - validation_split)).cast("bigint")
    return r.withColumn(split_col, F.when(F.col(_R) <= cut, "train").otherwise("validation")).drop(_R, _N)


def batches(df: DataFrame, order, batch_size: int = 32, batch_col: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows in the given order."""
    r = range_rank(df, [as_col(c) for c in order], _R)
    return r.withColumn(batch_col, F.floor((F.col(_R) - 1) / F.lit(batch_size)).cast("bigint")).drop(_R)


def shuffle(df: DataFrame, key: str = KEY, seed: int | str = 0, pos_col: str = "shuffle_pos") -> DataFrame:
    """Seeded random permutation, as a 1-based position column."""
    return hash_rank(df, key, seed, rank_col=pos_col, total_col=None)


def peek(df: DataFrame, key: str = KEY, seed: int | str = 0, n: int = 10) -> DataFrame:
    """First ``n`` rows of the seeded shuffle (a top-k, no full sort)."""
    return (
        df.withColumn(_H, hash_order_key(seed, key))
        .withColumn(_T, _row_hash(df, seed))
        .orderBy(_H, key, _T)
        .limit(n)
        .drop(_H, _T)
    )
