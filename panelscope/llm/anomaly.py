"""Quality rules: an isolation forest on rule statistics.

Each text becomes a short vector of rule statistics (shares of symbols,
repeated words and lines, digits, ...). A forest of random splits is grown on a
bounded sample of labelled rows (``TREES`` x ``SAMPLE``); texts that few splits
set apart have short paths and are anomalous. The threshold on the anomaly is the
one that sets bad from good labelled rows best: the share of bad rows at or
above it less ``COST`` times that of good rows, over all labelled rows that
pass the base rules. The statistics are written once and used three times."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import prepare, read, table, text_key, text_of

#: The bound of the sample: TREES * SAMPLE rows.
TREES, SAMPLE, SEED = 100, 256, 11
#: A lost share of the good rows weighs so many times a found share of the bad ones.
COST = 2.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbol_share", "repeat_share", "dup_line_share", "punct_share", "mean_word", "distinct_words")
SYMBOLS = "#*$%&|<>"


def statistics(text: str) -> list[float]:
    """The base counts, then the rule statistics, of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: ASCII white space only
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    chars = len(text) - spaces
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeat = 0
    if n >= 3:
        v = len(number) + 1
        if v < 2_000_000:
            key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:  # the product of three would not fit: number the pairs first
            _, two = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
            key = two[:-1].astype(np.int64) * v + ids[2:]
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        more = counts[which] > 1
        mark = np.zeros(n, bool)
        mark[:-2] |= more
        mark[1:-1] |= more
        mark[2:] |= more
        repeat = int(mark.sum())
    punct = sum(map(raw.count, (b".", b",", b";", b":", b"!", b"?", b"-", b"/", b"@", b"=", b"_")))
    c, m = max(chars, 1), max(n, 1)
    rules = [symbols / c, repeat / m, dup / max(lines, 1), punct / c, chars / m, math.log1p(len(number)) / math.log1p(m)]
    return [n, chars, symbols, dup, repeat, *rules]


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``rules`` of the base counts (bigint) and rule statistics (double). Null text: empty. A column ``rules`` is replaced."""
    prepare(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in RULES))
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([statistics(t or "") for t in texts], columns=[*BASE, *RULES])
        return out.astype({c: "int64" for c in BASE} | {c: "float64" for c in RULES})

    return docs.withColumn("rules", of_texts(text_of(text_col)))


def path_rest(n: np.ndarray) -> np.ndarray:
    """Mean further path length in a leaf of n rows: of an unsuccessful search in a binary search tree."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, deepest: int) -> list[tuple]:
    """A tree as rows (feature or -1, split, left, right, path length at a leaf)."""
    tree: list[tuple] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(tree)
        tree.append((-1, 0.0, -1, -1, depth + float(path_rest(len(rows)))))
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        can = np.flatnonzero(high > low)
        if depth < deepest and len(rows) > 1 and can.size:
            f = int(rng.choice(can))
            split = float(rng.uniform(low[f], high[f]))
            left = rows[:, f] < split
            tree[at] = (f, split, add(rows[left], depth + 1), add(rows[~left], depth + 1), 0.0)
        return at

    add(x, 0)
    return tree


def forest_of(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> dict:
    """A forest on bounded rows; each tree gets its own random share of them."""
    rng = np.random.default_rng(seed)
    grown = []
    if not len(x):
        return {"trees": grown, "norm": 1.0}
    each = min(sample, len(x))
    for _ in range(trees):
        rows = x[rng.choice(len(x), each, replace=False)]
        grown.append([np.array(c) for c in zip(*grow(rows, rng, math.ceil(math.log2(max(each, 2)))), strict=True)])
    return {"trees": grown, "norm": max(float(path_rest(each)), 1e-9)}


def anomaly(forest: dict, x: np.ndarray) -> np.ndarray:
    """2 ** -(mean path / usual path): towards 1 for anomalous rows, 0.5 without a forest."""
    if not forest["trees"] or not len(x):
        return np.full(len(x), 0.5)
    total = np.zeros(len(x))
    for f, split, left, right, leaf in forest["trees"]:
        at = np.zeros(len(x), np.int64)
        while (inner := f[at] >= 0).any():
            go = x[np.arange(len(x)), np.maximum(f[at], 0)] < split[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += leaf[at]
    return np.exp2(-total / len(forest["trees"]) / forest["norm"])


def score(rows: DataFrame, forest: dict, out: str = "anomaly") -> DataFrame:
    """``rows`` (with ``rules``) with their anomaly; the forest has bounded size."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def of_rows(x: pd.DataFrame) -> pd.Series:
        return pd.Series(anomaly(shared.value, x[list(RULES)].to_numpy(float)))

    return rows.withColumn(out, of_rows(F.struct(*(F.col(f"rules.{c}").alias(c) for c in RULES))))


def threshold(scored: DataFrame, quality: str = "quality", cost: float = COST) -> float:
    """The anomaly that sets rows of quality 0 from those of quality 1 best.
    From a count by thousandths of all labelled rows; without rows of both kinds: 2, which no anomaly reaches."""
    counts = scored.groupBy(F.floor(F.col("anomaly") * 1000).alias("m"), F.col(quality).alias("q")).count().collect()  # at most 1001 a quality
    good, bad = ({r["m"]: r["count"] for r in counts if r["q"] == q} for q in (1, 0))
    if not good or not bad:
        return 2.0
    best, t, lost, found = 0.0, 2.0, 0, 0
    for m in sorted(good.keys() | bad.keys(), reverse=True):
        lost, found = lost + good.get(m, 0), found + bad.get(m, 0)
        if (gain := found / sum(bad.values()) - cost * lost / sum(good.values())) > best:
            best, t = gain, m / 1000
    return t


def failed(rules: str = "rules") -> Column:
    """The base rules: fewer than 50 words, or more than half of the words repeated."""
    words = F.col(f"{rules}.n_words")
    return (words < 50) | (100 * F.col(f"{rules}.n_repeat_words") > 50 * words)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cost: float = COST) -> DataFrame:
    """id, the base counts, anomaly, threshold, base_failed and kept of each row.

    kept: the base rules hold and the anomaly is below the threshold. Null
    text: no words. Without labels of both kinds no anomaly is too high.
    Repeated rows and ids are judged each by its own text; the least quality
    of an id holds for all its rows."""
    rows = table(features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", text_key().alias("key"), "rules"), "rules")
    known = rows.join(labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality")), "id")
    # bounded: TREES * SAMPLE rows, taken by a hash of the text, copies once
    sample = known.groupBy("key").agg(F.min("rules").alias("rules")).orderBy(F.xxhash64("key"), "key").limit(TREES * SAMPLE).select("rules.*").toPandas()
    forest = forest_of(sample[list(RULES)].to_numpy(float))
    t = threshold(score(known.where(~failed()), forest), cost=cost)
    return score(rows, forest).select(
        F.col("id").alias(id_col), *(F.col(f"rules.{c}").alias(c) for c in BASE),
        "anomaly", F.lit(t).alias("threshold"), failed().alias("base_failed"), (~failed() & (F.col("anomaly") < t)).alias("kept"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, anomaly, threshold of each document."""
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept", "anomaly", "threshold")
