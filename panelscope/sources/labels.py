"""Label sources: whitespace-separated label text files, and the label
stand-in built from the ``labels`` table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.functions.ids import basename, zfill
from panelscope.functions.scalars import LABEL_EDGES, LABEL_NAMES, bin_label
from panelscope.functions.util import as_col
from panelscope.schema import KEY, SCHEMA_LABELS_ELPV, cast_to_schema
from panelscope.session import written

# Fixed values that must equal the reference's for the same results:
# label-file field widths (characters kept) for the path and the panel type,
# under the observed semantics only: a cut path no longer names its sample.
LABEL_PATH_CHARS = 19
LABEL_TYPE_CHARS = 4


def parse_label_lines(
    lines: DataFrame,
    filename,
    value_col: str = "value",
    edges=LABEL_EDGES,
    names=LABEL_NAMES,
    semantics: str = "documented",
) -> DataFrame:
    """Lines ``<path> <probability> <type>`` -> label frame (ELPV label schema).

    ``#`` starts a comment, blank lines are skipped, a probability that is not
    a number is NULL. The key is the base name of the path; the category is
    the right-closed bin of the probability. ``semantics="observed"`` cuts the
    path to 19 and the type to 4 characters, before the key is taken."""
    if semantics not in ("documented", "observed"):
        raise ValueError(semantics)
    cut = (lambda c, n: F.substring(c, 1, n)) if semantics == "observed" else (lambda c, n: c)
    body = F.trim(F.regexp_replace(F.col(value_col), "#.*$", ""))
    parts = F.split(body, r"\s+")
    prob = F.get(F.col("_p"), 1).try_cast("double")
    out = (
        lines.select(body.alias("_body"), parts.alias("_p"), as_col(filename).alias("LABEL_FILENAME"))
        .where(F.col("_body") != "")
        .select(
            cut(F.get("_p", 0), LABEL_PATH_CHARS).alias("LABEL_PATH"),
            F.when(~F.isnan(prob), prob).alias("PROBABILITY"),
            cut(F.get("_p", 2), LABEL_TYPE_CHARS).alias("TYPE"),
            "LABEL_FILENAME",
        )
        .withColumn(KEY, basename("LABEL_PATH"))
        .withColumn("LABEL_CATEGORY", bin_label("PROBABILITY", edges, names))
    )
    return cast_to_schema(out, SCHEMA_LABELS_ELPV)


def _require_files(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path):
        raise FileNotFoundError(f"Couldn't find label file: {path!r}.")


def scan_labels(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Read a label text file (or a folder / glob of them). Lines that are no
    labels are not told apart: see ``load_labels``."""
    _require_files(spark, path)
    lines = spark.read.text(path).withColumn("_file", F.input_file_name())
    return parse_label_lines(lines, F.col("_file"), **kw)


def reject_reason(value_col: str = "value", edges=LABEL_EDGES) -> Column:
    """Why a line that isn't blank or a comment is no label: NULL, or ``no
    probability``, ``not a number``, ``outside the bins``, ``no type``, ``too many fields``
    (the first that holds). ``nan`` is a missing probability and allowed."""
    parts = F.split(F.trim(F.regexp_replace(F.col(value_col), "#.*$", "")), r"\s+")
    prob = F.get(parts, 1).try_cast("double")
    return (
        F.when(F.size(parts) < 2, "no probability")
        .when(prob.isNull(), "not a number")
        .when(~F.isnan(prob) & ((prob <= edges[0]) | (prob > edges[-1])), "outside the bins")
        .when(F.size(parts) < 3, "no type")
        .when(F.size(parts) > 3, "too many fields")
    )


@dataclass
class LabelLoad:
    """Labels that parse, lines that don't (``LABEL_FILENAME``, ``line_no`` from 1,
    ``line``, ``reason``), and what was counted in the pass that read the files:
    ``lines`` (all), ``labels``, ``rejects``, and ``probabilities``, each value with
    its number of labels (None beyond ``DISTINCT`` values)."""

    labels: DataFrame
    rejects: DataFrame
    lines: int
    n_labels: int
    n_rejects: int
    probabilities: dict[float, int] | None

    def require_values(self, n: int) -> "LabelLoad":
        """Refuse labels that have not exactly ``n`` different probabilities."""
        found = "more than " + str(DISTINCT) if self.probabilities is None else len(self.probabilities)
        if found != n:
            raise ValueError(f"The labels must have {n} different probabilities, but have {found}.")
        return self


#: Different probabilities that a load lists.
DISTINCT = 64


def load_labels(spark: SparkSession, path: str, edges=LABEL_EDGES, names=LABEL_NAMES, strict: bool = False, semantics: str = "documented") -> LabelLoad:
    """Read label files once: what parses becomes labels, malformed lines go to a
    table of rejects, and counts come from an ``Observation`` of the same pass.

    Blank lines and comments are neither. ``strict`` raises ``ValueError``, with
    the first rejects, if there are any. Line numbers follow from each line's place
    in its block of the file and the number of lines in the blocks before it."""
    _require_files(spark, path)
    body = F.trim(F.regexp_replace("value", "#.*$", ""))
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("reason", F.when(body != "", reject_reason("value", edges))).withColumn("blank", body == "")
    good = ~F.col("blank") & F.col("reason").isNull()
    watch = Observation()
    prob = F.get(F.split(body, r"\s+"), 1).try_cast("double")
    seen = lines.withColumn("p", F.when(good & ~F.isnan(prob), prob)).observe(
        watch, F.count(F.lit(1)).alias("lines"), F.count_if(good).alias("labels"), F.count("reason").alias("rejects"),
        F.expr(f"approx_top_k(p, {DISTINCT + 1})").alias("values"),
    )
    read = written(seen.drop("p"), "label-lines")
    got = watch.get
    # exact as long as all values fit into the sketch; the missing ones are listed too
    values = {v["item"]: v["count"] for v in got["values"] if v["item"] is not None}
    blocks = read.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", "first", before.alias("before"))
    bad = read.where(F.col("reason").isNotNull()).join(starts, ["file", "block"])
    number = F.col("before") + F.col("at") - F.col("first") + 1
    rejects = bad.select(F.col("file").alias("LABEL_FILENAME"), number.alias("line_no"), F.col("value").alias("line"), "reason")
    if strict and got["rejects"]:
        some = "; ".join(f"{r['LABEL_FILENAME']}:{r['line_no']} {r['reason']}" for r in rejects.orderBy("LABEL_FILENAME", "line_no").limit(3).collect())
        raise ValueError(f"{got['rejects']} malformed label line(s): {some}")
    labels = parse_label_lines(read.where(~F.col("blank") & F.col("reason").isNull()), F.col("file"), edges=edges, names=names, semantics=semantics)
    return LabelLoad(labels, rejects, got["lines"], got["labels"], got["rejects"], values if len(values) <= DISTINCT else None)


# ---- stand-ins from the driver tables -------------------------------------

def sample_id_from_int(c, prefix: str = "cell", width: int = 4, suffix: str = ".png") -> Column:
    """Integer key -> sample id such as ``cell0042.png`` (never truncated)."""
    return F.concat(F.lit(prefix), zfill(as_col(c), width), F.lit(suffix))


def probability_from_flags(quality="quality", toxic="toxic") -> Column:
    """Four exact levels 0, 1/3, 2/3, 1 from the two 0/1 flags."""
    return (F.lit(2.0) * (F.lit(1) - as_col(quality)) + as_col(toxic)) / F.lit(3.0)


def label_lines_from_table(labels: DataFrame) -> DataFrame:
    """The ``labels`` table written as label-file lines (one per row)."""
    return labels.select(
        F.concat_ws(
            " ",
            F.concat(F.lit("images/"), sample_id_from_int("doc_id")),
            probability_from_flags().cast("string"),
            F.when(F.col("toxic") == 1, F.lit("mono")).otherwise(F.lit("poly")),
        ).alias("value")
    )


def labels_from_table(labels: DataFrame, label_file: str = "labels.csv") -> DataFrame:
    return parse_label_lines(label_lines_from_table(labels), F.lit(label_file))
