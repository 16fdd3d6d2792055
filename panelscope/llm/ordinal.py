"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = sigmoid(theta_k - w . x): one weight vector for all
grades over hashed features of the text, and ordered thresholds. It gives an
expected grade and the probability of a grade in the tail, by which texts are
selected.

The fit reads at most ``FIT_ROWS`` rated rows, dealt over tasks. In each round
every task improves the shared weights on its rows by adaptive gradient
steps; the changes are averaged by Spark and sent out again. The weights have a
fixed number of buckets, whatever the corpus. All texts are scored whole."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import crc_mod, prepare, read, table, text_of

#: Bounds: rated rows that the fit reads, buckets of features.
FIT_ROWS, BUCKETS = 12_000, 1 << 14
ROUNDS, EPOCHS, TASKS, RATE, DECAY = 4, 2, 6, 0.3, 1e-6
#: A text is selected if a grade of TAIL or more has at least this probability.
TAIL, CUT = 1, 0.5
#: Length of the vector of a text's words; each statistic has value 1.
WORDS = 1.0
SYMBOLS = b"#*$%&|<>!"


class Features:
    """Hashed features of a text: buckets and values. Words by themselves and by
    their start; statistics of the whole text in classes of their size."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def of_word(self, w: bytes) -> tuple[int, int]:
        if (got := self.known.get(w)) is None:
            core = w.strip(b".,;:!?#*$%&|<>()[]\"'")
            got = (zlib.crc32(b"w" + core) % self.buckets, zlib.crc32(b"p" + core[:6]) % self.buckets)
            if len(self.known) < 80_000:
                self.known[w] = got
        return got

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        n = len(words)
        distinct = set(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        chars = max(sum(map(len, words)), 1)
        stats = {
            "symbols": sum(map(raw.count, (bytes([c]) for c in SYMBOLS))) / chars,
            "distinct": 1 - len(distinct) / max(n, 1) if n < 200 else 1 - math.log(len(distinct)) / math.log(n),
            "lines": 1 - len(set(lines)) / max(len(lines), 1),
            "upper": sum(w.isupper() for w in raw.split()) / max(n, 1),
            "length": chars / max(n, 1) / 10,
            "few": 1 / (1 + n / 20),
            "again": sum(map(bytes.__eq__, words, words[1:])) / max(n, 1),
        }
        at = [zlib.crc32(f"{k}{min(9, int(v * 20))}".encode()) % self.buckets for k, v in stats.items()]
        value = [1.0] * len(at)
        if distinct:
            ids = np.array([self.of_word(w) for w in distinct], np.int64).ravel()
            at.extend(ids.tolist())
            value.extend([WORDS / math.sqrt(ids.size)] * ids.size)
        return np.array(at, np.int64), np.array(value)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradient(z: float, theta: np.ndarray, grade: int) -> tuple[float, np.ndarray]:
    """Of -log P(grade): by the text's value z, and by the thresholds."""
    k = len(theta)
    low = sigmoid(theta[grade - 1] - z) if grade > 0 else 0.0
    high = sigmoid(theta[grade] - z) if grade < k else 1.0
    p = max(high - low, 1e-9)
    dl, dh = low * (1 - low), high * (1 - high)
    by = np.zeros(k)
    if grade > 0:
        by[grade - 1] = dl / p
    if grade < k:
        by[grade] = -dh / p
    return (dh - dl) / p, by


def improve(rows: list[tuple[np.ndarray, np.ndarray, int]], w: np.ndarray, theta: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights and thresholds after adaptive gradient steps over the rows."""
    w, theta, rng = w.copy(), theta.copy(), np.random.default_rng(seed)
    g2, t2 = np.full(w.size, 1e-2), np.full(theta.size, 1e-2)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, grade = rows[i]
            dz, dt = gradient(float(w[at] @ x), theta, grade)
            g = np.clip(dz, -4, 4) * x + DECAY * w[at]
            g2[at] += g * g
            w[at] -= RATE * g / np.sqrt(g2[at])
            t2 += dt * dt
            theta -= RATE * np.clip(dt, -4, 4) / np.sqrt(t2)
            theta = np.maximum.accumulate(theta + np.arange(theta.size) * 1e-6)
    return w, theta


class Model:
    def __init__(self, w: np.ndarray, theta: np.ndarray):
        self.w, self.theta = w, theta
        self.features = Features(w.size)

    def __getstate__(self):
        return self.w, self.theta

    def __setstate__(self, state):
        self.__init__(*state)

    def grades(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        at, x = self.features.of(text)
        return 1 - sigmoid(self.theta - float(self.w[at] @ x))


def learn(rated: DataFrame, grades: int, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS) -> Model:
    """The model of the columns text and grade (0 to grades - 1; others and
    nulls are left out), from at most ``fit_rows`` rows, taken by a hash of the text. No rows: thresholds by even odds, weights 0."""
    spark = rated.sparkSession
    prepare(spark)
    rows = rated.where(F.col("grade").between(0, grades - 1)).select(text_of().alias("text"), F.col("grade").cast("int").alias("grade"))
    rows = rows.orderBy(F.xxhash64("text"), "grade").limit(fit_rows)
    rows = table(rows.repartition(TASKS, F.xxhash64("text")).select("text", "grade"), "rated")
    w = np.zeros(buckets)
    counts = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    total = sum(counts.values())
    below = np.cumsum([counts.get(k, 0) + 1 for k in range(grades - 1)])
    share = below / (total + grades)
    theta = np.log(share / (1 - share))
    if not total:
        return Model(w, theta)
    dealt = rows.select("text", "grade", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(TASKS)).cast("int").alias("task"))
    dealt = dealt.repartition(TASKS, "task").sortWithinPartitions("task", F.xxhash64("text"))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((w, theta))

        def step(batches, k=k, shared=shared):
            w0, theta0 = shared.value
            features, tasks = Features(w0.size), {}
            for batch in batches:
                for text, grade, task in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    tasks.setdefault(task, []).append((*features.of(text), grade))
            for task, mine in tasks.items():
                w1, theta1 = improve(mine, w0, theta0, EPOCHS, 1000 * k + task)
                at = np.flatnonzero(w1 != w0)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1 - np.arange(theta1.size)]), pa.array(np.r_[(w1 - w0)[at], theta1 - theta0]), pa.array(np.full(at.size + theta1.size, len(mine)))], ["at", "d", "n"])

        moved = dealt.mapInArrow(step, "at long, d double, n long").groupBy("at").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("d")).toPandas()  # at most one row a bucket
        at, d = moved["at"].to_numpy(int), moved["d"].to_numpy(float)
        w, theta = w.copy(), theta.copy()
        w[at[at >= 0]] += d[at >= 0]
        theta[-1 - at[at < 0]] += d[at < 0]
        theta = np.maximum.accumulate(theta)
    return Model(w, theta)


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Three grades from the labels: 0 bad, 1 good but toxic, 2 good."""
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).when(F.col(quality) == 1, 2)


def score(docs: DataFrame, model: Model, tail: int = TAIL, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade (0 to the highest) and tail_probability (of a
    grade of ``tail`` or more). Null text: empty. Columns of these names are replaced; repeated rows are scored alike."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        p = np.array([shared.value.grades(t or "") for t in texts]).reshape(len(texts), -1)
        return pd.DataFrame({"expected_grade": p.sum(1), "tail_probability": p[:, tail - 1]})

    keep = [c for c in docs.columns if c.lower() not in ("expected_grade", "tail_probability")]
    own = F.struct(*(F.col(c) for c in keep))
    got = docs.select(own.alias("own"), of_texts(text_of(text_col)).alias("s"))
    return got.select(*(F.col("own").getField(c).alias(c) for c in keep), "s.expected_grade", "s.tail_probability")


def op10_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept of each document; learnt from rows that are not held out (crc32 of the id modulo 3 is not 1)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rated = labels.where(crc_mod("doc_id", 3) != 1).withColumn("grade", grade_of()).where("grade is not null")
    model = learn(docs.join(rated, "doc_id"), 3)
    got = score(docs, model)
    return got.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= CUT).alias("kept"))
