"""The label ⨝ sample merge and its guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.schema import KEY, merge_schemas


#: Rows of one key from which a full outer merge is put together from joins that adaptive execution can split.
HOT_KEY = 100_000


def _key_counts(labels: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """(key, _nl, _ns): rows of each key on either side, in one shuffle of the key column."""
    tagged = labels.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_s")).unionByName(
        samples.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_s"))
    )
    return tagged.groupBy(key).agg(F.sum("_l").alias("_nl"), F.sum("_s").alias("_ns"))


def _report_columns() -> list:
    return [
        F.coalesce(F.sum("_nl"), F.lit(0)).cast("bigint").alias("n_labels"),
        F.coalesce(F.sum("_ns"), F.lit(0)).cast("bigint").alias("n_samples"),
        F.count_if(F.col("_ns") == 0).alias("labels_without_sample"),
        F.count_if(F.col("_nl") == 0).alias("samples_without_label"),
        F.count_if(F.col("_nl") > 1).alias("repeated_label_keys"),
        F.count_if(F.col("_ns") > 1).alias("repeated_sample_keys"),
        F.count_if((F.col("_nl") > 1) & (F.col("_ns") > 1)).alias("keys_repeated_on_both_sides"),
    ]


def merge_key_report(labels: DataFrame, samples: DataFrame, key: str = KEY) -> DataFrame:
    """One-row check frame for the merge guards: row counts, keys only on one
    side, keys repeated on a side, keys repeated on both sides. One shuffle of
    the key column (tagged by side, partially aggregated before it)."""
    return _key_counts(labels, samples, key).agg(*_report_columns())


def full_outer_split(labels: DataFrame, samples: DataFrame, key: str = KEY) -> DataFrame:
    """The full outer join as an inner join and the rows of either side without
    a partner. A full outer join leaves all rows of a key to one task; of these three,
    adaptive execution divides a hot key on either side. A null key has no partner."""
    both = labels.join(samples, key)
    lone = labels.join(samples.select(key), key, "left_anti")
    rest = samples.join(labels.select(key), key, "left_anti")
    return both.unionByName(lone, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


def merge_labels_samples(
    labels: DataFrame,
    samples: DataFrame,
    key: str = KEY,
    check: str = "counts",
    how: str = "full_outer",
    sort: bool = False,
) -> DataFrame:
    """Full outer equi-join of labels and samples on the key, key first.

    check: ``"counts"`` (the reference's guard: equal row counts, else
    ``ValueError``; plus the ``"pairs"`` guard), ``"pairs"`` (refuse a key
    repeated on both sides: the join would emit every pair of such rows),
    ``"strict"`` (one-to-one: no unmatched or repeated keys), ``"none"``.
    The guards are one aggregate over the pre-aggregated key columns. The
    type of the key and every shared column must agree. ``sort=True`` orders
    the result by key (a range-partitioned sort)."""
    if key not in labels.columns or key not in samples.columns:
        raise ValueError(f"Both sides need the key column {key!r}.")
    if labels.schema[key].dataType != samples.schema[key].dataType:
        raise ValueError(
            f"Cannot merge label data with sample data: key {key!r} is "
            f"{labels.schema[key].dataType.simpleString()} vs {samples.schema[key].dataType.simpleString()}."
        )
    merge_schemas(labels.schema, samples.schema)  # shared columns must have one type
    shared = (set(labels.columns) & set(samples.columns)) - {key}
    if shared:
        raise ValueError(f"Columns on both sides besides the key: {sorted(shared)}")
    hot = False
    if check in ("counts", "strict", "pairs"):
        most = F.coalesce(F.max(F.greatest("_nl", "_ns")), F.lit(0)).alias("most")
        rep = _key_counts(labels, samples, key).agg(*_report_columns(), most).first().asDict()
        hot = rep.pop("most") >= HOT_KEY
        if rep["keys_repeated_on_both_sides"]:
            raise ValueError(
                f"{rep['keys_repeated_on_both_sides']} key(s) repeat in both labels and samples; "
                "the merge would emit every pair of their rows."
            )
        if check != "pairs" and rep["n_labels"] != rep["n_samples"]:
            raise ValueError(
                f"There are {rep['n_labels']} labels but {rep['n_samples']} samples; each sample needs one label."
            )
        if check == "strict":
            bad = {k: v for k, v in rep.items() if k.startswith(("labels_", "samples_", "repeated_")) and v}
            if bad:
                raise ValueError(f"Labels and samples are not one-to-one: {bad}")
    elif check != "none":
        raise ValueError(f"Unknown check {check!r}.")
    outer = how.replace("_", "").lower() in ("full", "outer", "fullouter")
    out = full_outer_split(labels, samples, key) if hot and outer else labels.join(samples, key, how)
    out = out.select(key, *[c for c in out.columns if c != key])
    return out.orderBy(key) if sort else out


def anti_join_split(full: DataFrame, part: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of ``full`` whose key is not in ``part``."""
    return full.join(part.select(key), key, "left_anti")
