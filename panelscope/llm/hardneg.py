"""Hard-negative mining by exact inner-product search with segment summaries.

A vector is cut into 1, 2, 4, ... ``FINEST`` segments. For each segment its
mean and its deviation are stored (both times the root of the segment's
length). The inner product of two segments is the product of their means plus
a remainder that the product of their deviations bounds (Cauchy-Schwarz), so
the sums over a level's segments give a lower and an upper bound of the score.
A pair goes on to the next, finer level only while its bounds meet the range of
scores that is still wanted; what passes the finest level is scored exactly.

The anchors are the stated query set. They go out in blocks of at most
``BLOCK_BYTES``; each block is compared with all rows where these are read, so
the rows are never shuffled, and a task sends at most ``k`` rows on for each
anchor and range. The best of all tasks are taken by a window, of which Spark
keeps ``k`` rows a key before the shuffle as well. The rows are a table in the
shared folder, so a lost task is run again with the same row numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.llm.common import prepare, read, table

FINEST = 16
BLOCK_BYTES, CELLS = 16 << 20, 1 << 21
#: Share of |x||y| that float32 sums may be off by, with room to spare.
SLACK = 1e-5
LEAST, MOST = -(2**63), 2**63 - 1
ROWS = "row long, id long, label long, x array<bigint>, mean array<float>, dev array<float>"
FOUND = "query long, slot int, score long, id long, row long"


def cuts(dim: int) -> list[np.ndarray]:
    """The starts of the segments at each level; a level's cuts are among those of the next."""
    levels, m = [], 1
    while m <= max(1, min(FINEST, dim // 2)):
        levels.append(np.arange(m) * dim // m)
        m *= 2
    return levels


def dense(lists: pa.ListArray, dim: int, kind) -> np.ndarray:
    """Lists as rows of ``dim`` numbers, short ones filled up with zeros."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if (ends == dim).all():
        return flat.astype(kind).reshape(len(lists), dim)
    out = np.zeros((len(lists), dim), kind)
    out[np.arange(dim) < ends[:, None]] = flat
    return out


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all levels side by side, each times the root of its segment's length."""
    n, dim = x.shape
    if not n or not dim:
        return np.zeros((n, 1)), np.zeros((n, 1))
    means, devs = [], []
    for at in cuts(dim):
        size = np.diff(np.append(at, dim))
        mean = np.add.reduceat(x, at, axis=1) / size
        devs.append(np.sqrt(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, at, axis=1)))
        means.append(mean * np.sqrt(size))
    return np.hstack(means), np.hstack(devs)


def bounded(x: dict, y: dict, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of x, row of y) in ``alive`` whose score may lie in [low, high] of y's row, as two index arrays."""
    rows, cols, done, levels = np.arange(alive.shape[0]), np.arange(alive.shape[1]), 0, len(cuts(x["dim"]))
    for m in (1 << i for i in range(levels)):
        r, c = alive.any(1), alive.any(0)
        rows, cols, alive = rows[r], cols[c], alive[np.ix_(r, c)]
        if not alive.size:
            break
        part = slice(done, done + m)
        mid = x["mean"][rows, part] @ y["mean"][cols, part].T
        off = x["dev"][rows, part] @ y["dev"][cols, part].T
        off += SLACK * x["norm"][rows, None] * y["norm"][cols] + 1
        alive &= (mid + off >= low[cols]) & (mid - off <= high[cols])
        done += m
    i, j = np.nonzero(alive)
    return rows[i], cols[j]


def exact(x: dict, y: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of the pairs (i, j), as 64-bit integers."""
    if x["wide"]:
        return np.concatenate([np.zeros(0, np.int64), *((x["x"][i[s : s + 65536]] * y["x"][j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536))])
    rows, cols = np.unique(i), np.unique(j)
    if len(i) * 8 > len(rows) * len(cols):
        scores = x["x"][rows] @ y["x"][cols].T
        return scores[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x["x"][i[s : s + 65536]], y["x"][j[s : s + 65536]]) for s in range(0, len(i), 65536))]).astype(np.int64)


def side(batch: pa.RecordBatch | pa.Table, dim: int, wide: bool) -> dict:
    """What scoring needs of rows of ROWS."""
    one = lambda n: (c.combine_chunks() if isinstance(c := batch[n], pa.ChunkedArray) else c)
    width = sum(map(len, cuts(dim)))
    out = {n: dense(one(n), width, np.float32) for n in ("mean", "dev")}
    ids = one("id")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    norm = np.sqrt(out["mean"][:, 0].astype(float) ** 2 + out["dev"][:, 0].astype(float) ** 2).astype(np.float32)
    return out | {"x": dense(one("x"), dim, np.int64 if wide else np.float64), "norm": norm, "dim": dim, "wide": wide, "id": ids.fill_null(0).to_numpy(), "known": known} | {n: one(n).to_numpy() for n in ("row", "label")}


class Best:
    """The k best (score, id, row) of each key met so far: score downwards, then id (none last), then row."""

    def __init__(self, keys: int, k: int):
        self.k, self.floor = k, np.full(keys, LEAST)
        self.kept = {n: np.zeros(0, t) for n, t in (("key", np.int64), ("score", np.int64), ("id", np.int64), ("known", bool), ("row", np.int64))}

    def add(self, **new: np.ndarray) -> None:
        both = {n: np.concatenate([self.kept[n], new[n]]) for n in self.kept}
        order = np.lexsort((both["row"], both["id"], ~both["known"], ~both["score"], both["key"]))
        key = both["key"][order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        self.kept = {n: v[order][place < self.k] for n, v in both.items()}
        last = place == self.k - 1
        self.floor[key[last]] = both["score"][order][last]


def search(batches: Iterator[pa.RecordBatch], block: dict, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """The k best rows of a task for each anchor and range of ``block``: of the anchor's label (``same``) or of another. Never the anchor's own row."""
    y = side(block["rows"], block["dim"], block["wide"])
    low, high = block["low"], block["high"]  # anchors x ranges
    slots = low.shape[1]
    best = Best(low.size, k)
    step = max(1, CELLS // max(1, len(low)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            x = side(batch.slice(start, step), block["dim"], block["wide"])
            alike = x["label"][:, None] == y["label"]
            alive = (alike if same else ~alike) & (x["row"][:, None] != y["row"])
            floor = np.maximum(low, best.floor.reshape(low.shape))
            if block["wide"]:
                i, j = np.nonzero(alive)
            else:
                open_ = floor <= high
                i, j = bounded(x, y, alive & open_.any(1), np.where(open_, floor, MOST).min(1), np.where(open_, high, LEAST).max(1))
            score = exact(x, y, i, j)
            fits = [np.nonzero((score >= floor[j, s]) & (score <= high[j, s]))[0] for s in range(slots)]
            at = np.concatenate(fits)
            key = j[at] * slots + np.repeat(np.arange(slots), [len(f) for f in fits])
            best.add(key=key, score=score[at], **{n: x[n][i[at]] for n in ("id", "known", "row")})
    b = best.kept
    for s in range(0, len(b["key"]), 50_000):
        p = slice(s, s + 50_000)
        query = y["row"][b["key"][p] // slots]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array((b["key"][p] % slots).astype(np.int32)), pa.array(b["score"][p]), pa.array(b["id"][p], mask=~b["known"][p]), pa.array(b["row"][p])],
            names=["query", "slot", "score", "id", "row"],
        )


def summarised(vectors: DataFrame, dim: int) -> DataFrame:
    """ROWS of (id, label, x): row numbers and the segments' summaries."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            mean, dev = summaries(dense(batch["x"], dim, np.float64))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.astype(np.float32).ravel())) for v in (mean, dev)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + batch.num_rows)), batch["id"], batch["label"], batch["x"], *lists], names=["row", "id", "label", "x", "mean", "dev"])
            n += batch.num_rows

    return vectors.mapInArrow(add, ROWS)


def best_of(rows: DataFrame, anchors: DataFrame, shape: dict, blocks: int, k: int, same: bool, what: str) -> DataFrame:
    """FOUND with the ``rank`` (from 1): the k best rows of each (anchor, range) of
    ``anchors`` (ROWS with low, high: array<long>, equally long in all rows)."""
    out = None
    for b in range(blocks):
        # at most BLOCK_BYTES or thereabouts, by the count of the anchors and their length
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        if not own.num_rows:
            continue
        ranges = {n: dense(own[n].combine_chunks(), len(own[n][0]), np.int64) for n in ("low", "high")}
        sent = rows.sparkSession.sparkContext.broadcast({"rows": own.drop(["low", "high"]), **ranges, **shape})
        got = rows.mapInArrow(lambda it, sent=sent: search(it, sent.value, k, same), FOUND)
        order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        got = table(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), what)
        sent.unpersist()
        out = got if out is None else out.unionByName(got)
    return out if out is not None else rows.sparkSession.createDataFrame([], f"{FOUND}, rank int")


def mine(vectors: DataFrame, anchor: str, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", x_col: str = "x", label_col: str = "label") -> DataFrame:
    """Hard negatives of the rows of ``vectors`` that satisfy ``anchor`` (an SQL
    condition on ``id``): anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    ``x_col`` is a list of whole numbers, the label a whole number, a score the
    inner product. An anchor's positives are its ``n_positives`` best other rows
    of its label, ties by smaller id; for each of them the first
    ``n_negatives`` rows of other labels with ``low`` * positive score <= 100 *
    score <= ``high`` * positive score.

    Rows with a null label, vector or component take no part. A null id is no
    anchor and comes last among ties. Shorter vectors count as filled up with
    zeros, empty ones score 0. Of repeated rows each is a row of its own.
    Scores beyond 64 bits wrap around like Spark's long sums; if any could
    exceed 53 bits, all pairs are scored by integers. Other columns are not
    read. No anchors or an empty table: no rows."""
    prepare(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(x_col).cast("array<bigint>").alias("x"))
    v = table(v.where(F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull())), "vectors")
    size = v.agg(F.max(F.size("x")), F.max(F.expr("aggregate(x, 0D, (m, c) -> greatest(m, abs(cast(c as double))))")), F.count_if(F.expr(anchor))).first()
    dim, n = size[0] or 0, size[2]
    shape = {"dim": max(1, dim), "wide": dim * (size[1] or 0) ** 2 >= 2**53}
    rows = table(summarised(v, shape["dim"]), "rows")
    anchors = rows.where(F.expr(anchor) & F.col("id").isNotNull())
    blocks = max(1, math.ceil(n * (shape["dim"] * 8 + 16 * FINEST + 64) / BLOCK_BYTES))
    whole = anchors.withColumn("low", F.array(F.lit(LEAST))).withColumn("high", F.array(F.lit(MOST)))
    positives = best_of(rows, whole, shape, blocks, n_positives, True, "positives")
    # one range for each score among an anchor's positives; the others are empty
    floor = -F.floor(-F.col("score").cast("decimal(20,0)") * low / 100).cast("long")
    top = F.floor(F.col("score").cast("decimal(20,0)") * high / 100).cast("long")
    ranges = positives.where(floor <= top).groupBy(F.col("query").alias("row")).agg(F.sort_array(F.collect_set(F.struct("score", floor.alias("low"), top.alias("high")))).alias("r"))
    fill = lambda f, to: F.expr(f"transform(sequence(0, {n_positives - 1}), i -> coalesce(get(r, i).{f}, {to}))")
    asked = table(ranges.select("row", "r", fill("low", MOST).alias("low"), fill("high", LEAST + 1).alias("high")), "ranges")
    negatives = best_of(rows, anchors.join(asked.drop("r"), "row"), shape, blocks, n_negatives, False, "negatives")
    by_score = asked.select(F.col("row").alias("query"), F.posexplode("r").alias("slot", "r")).select("query", "slot", F.col("r.score").alias("positive_score"))
    given = negatives.join(by_score, ["query", "slot"]).select("query", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = positives.select("query", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("query"), F.col("id").alias("anchor_id"))
    got = pairs.join(given, ["query", "positive_score"]).join(ids, "query")
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of the embeddings whose id is divisible by 100."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    e = e.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", label.alias("label"), F.transform("v", lambda c: F.floor(256 * c)).alias("x")), "id % 100 = 0")


#: The same in SQL, every anchor against every row.
SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same,
  list_inner_product(a.x::DOUBLE[], b.x::DOUBLE[])::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r != b.r),
p AS (SELECT a, anchor_id, b, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id NULLS LAST)::INT AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
