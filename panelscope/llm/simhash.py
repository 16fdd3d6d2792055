"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits and link at ``distance`` or fewer differing bits.
The bits fall into blocks; by the pigeonhole two linked fingerprints differ in
at most ``t = distance // blocks`` bits of some block. In each block the code
words of a covering code with radius R are the anchors: every point has one
within R. A fingerprint goes to every anchor within R + t of its block. Of two
that link in a block, the first has an anchor within R, and the second lies
within R + t of that one, so both meet there: no link is missed.

A block's code is the direct sum of the binary Hamming code of length 15
(perfect, R = 1) and the free code on the bits left (R = 0). With three
blocks (21, 21 and 22 bits; t = 1) a fingerprint has about 14 anchors a block, of
2^17 or 2^18. ``blocks`` trades copies of a fingerprint against the size of a
group, which is the number of fingerprints times 14 / 2^17.

Equal fingerprints are one node throughout, so copies cost nothing. In a group
a search from member to member yields a spanning forest of the links, never
all pairs. Groups above ``PART`` members are dealt in parts, and each pair of
parts is a task's group of its own, so no task gets an unbounded group."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import fresh, prepare, read, table, text_key, text_of
from panelscope.llm.components import components

#: Members of a group that one task compares at once.
PART = 2048


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles, as a signed integer; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    total, seen = np.zeros(64, np.int64), 0
    while seen < n:  # in parts, for texts of any length
        m = min(n - seen, 16_384)
        part = words[seen : seen + m + shingle - 1]
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in map(b" ".join, zip(*(part[k:] for k in range(shingle))))] if len(words) >= shingle else [xxhash.xxh64_intdigest(b" ".join(words), 42)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        seen += m
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 4) -> DataFrame:
    """``docs`` with ``out``: the fingerprint as bigint (its bits as two's
    complement). Null text: no words, fingerprint 0. A column ``out`` is replaced."""
    prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t or "", shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, of_texts(text_of(text_col)))


def blocks_of(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block; together the 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(x, y - x) for x, y in zip(edges, edges[1:], strict=False)]


def hamming_syndrome(x: np.ndarray) -> np.ndarray:
    """Of 15-bit words: the exclusive or of the positions 1..15 of the bits set; 0 for code words."""
    s = np.zeros(len(x), np.int64)
    for k in range(15):
        s ^= ((x >> k) & 1) * (k + 1)
    return s


def patterns(width: int, reach: int) -> dict[int, np.ndarray]:
    """By syndrome: the bit patterns of weight up to ``reach`` that lead from a word of that syndrome to a code word."""
    if width < 15:
        raise ValueError("a block needs 15 bits or more; use fewer blocks")
    weights = [p for r in range(reach + 1) for p in itertools.combinations(range(width), r)]
    masks = np.array([sum(1 << k for k in p) for p in weights], np.int64)
    s = hamming_syndrome(masks & 0x7FFF)
    return {k: masks[s == k] for k in range(16)}


def anchors(points: DataFrame, fp: str, distance: int = 4, blocks: int = 3) -> DataFrame:
    """(block, anchor, fp) rows: each fingerprint at every anchor within reach."""
    layout = [(k, shift, width, patterns(width, 1 + distance // blocks)) for k, (shift, width) in enumerate(blocks_of(blocks))]

    def replicate(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, shift, width, table_ in layout:
                words = (fps.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
                s = hamming_syndrome(words & 0x7FFF)
                for syndrome, masks in table_.items():
                    if (at := np.flatnonzero(s == syndrome)).size:
                        found = (words[at][:, None] ^ masks[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(found.size, k, np.int32)), pa.array(found), pa.array(np.repeat(fps[at], len(masks)))], ["block", "anchor", "fp"])

    return points.select(F.col(fp).cast("long")).mapInArrow(replicate, "block int, anchor long, fp long")


def differ(x, y):
    """Differing bits of two fingerprints (arrays or numbers of int64)."""
    return np.bitwise_count(np.bitwise_xor(x, y).view(np.uint64))


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of links that span the components of the points: a search that
    takes each point once and compares it with those not yet reached."""
    left, a, b = fps, [], []
    stack: list[int] = []
    while left.size:
        if not stack:
            stack, left = [left[0]], left[1:]
        x = stack.pop()
        near = differ(left, x) <= distance
        if near.any():
            got = left[near]
            left = left[~near]
            stack.extend(got)
            a.append(np.full(got.size, x))
            b.append(got)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _links_of_runs(key: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys. Short runs are compared together, by
    shifting the arrays against each other; long ones by the search."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, key.size])
    a, b = [], []
    short = np.repeat(sizes <= 32, sizes)
    k, f = key[short], fps[short]
    for shift in range(1, 32):
        if shift >= k.size:
            break
        hit = (k[shift:] == k[:-shift]) & (differ(f[shift:], f[:-shift]) <= distance)
        a.append(f[:-shift][hit])
        b.append(f[shift:][hit])
    for at in np.flatnonzero(sizes > 32):
        x, y = forest(fps[starts[at] : starts[at] + sizes[at]], distance)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def links(points: DataFrame, fp: str = "fp", distance: int = 4, blocks: int = 3, part: int = PART) -> DataFrame:
    """(a, b) links whose components are those of all links at ``distance`` or
    fewer bits. ``points``: distinct fingerprints."""
    spark = points.sparkSession
    at = table(anchors(points, fp, distance, blocks), "anchors")
    sizes = at.groupBy("block", "anchor").count()
    hot = table(sizes.where(F.col("count") > part).withColumn("parts", F.ceil(F.col("count") / part).cast("int")), "hot-anchors")
    near = "block int, anchor long, x int, y int, fp long"

    def in_groups(batches):
        kept_k, kept_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        run = 0

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            new = np.zeros(batch.num_rows, bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in cols[:4])
            new[0] = first != last
            last = tuple(c[-1] for c in cols[:4])
            ids = run + np.cumsum(new)
            run = int(ids[-1])
            k, f = np.r_[kept_k, ids], np.r_[kept_f, cols[4].astype(np.int64)]
            done = k < run  # the last run may go on in the next batch
            a, b = _links_of_runs(k[done], f[done], distance) if done.any() else (f[:0], f[:0])
            kept_k, kept_f = k[~done], f[~done]
            if a.size:
                yield out(a, b)
        if kept_k.size:
            a, b = _links_of_runs(kept_k, kept_f, distance)
            if a.size:
                yield out(a, b)

    plain = at.join(hot, ["block", "anchor"], "left_anti").select("block", "anchor", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    # each member of a hot group is in one part, and meets the others in the pairs of parts
    dealt = at.join(hot, ["block", "anchor"]).withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "anchor", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    out = None
    for rows in (plain, pairs):
        dealt_out = rows.repartition("block", "anchor", "x", "y").sortWithinPartitions("block", "anchor", "x", "y").select(*near.replace(" int", "").replace(" long", "").split(", "))
        got = dealt_out.mapInArrow(in_groups, "a long, b long")
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, blocks: int = 3) -> DataFrame:
    """(fp, id, key, root, component) for each row: its fingerprint, the
    128-bit key of its text, a fingerprint that names its group, and the
    smallest id whose fingerprint it reaches by links.

    Null text: no words, fingerprint 0. Rows that repeat an id are rows like
    others; a null id is no candidate for the smallest (a component of null
    ids alone has a null name). Empty table: no rows. Names of other columns don't matter."""
    rows = table(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle=shingle).select("id", text_key().alias("key"), "fp"), "fingerprints")
    points = table(rows.groupBy("fp").agg(F.min("id").alias("least")), "points")
    nodes = components(links(points, "fp", distance, blocks)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = points.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    label = named.join(least, "root").select("fp", "root", "component")
    return rows.join(label, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id (of
    rows with the same id and differing texts, the one with the least text key;
    of repeated rows, one). Null ids come last. Columns stay as they are."""
    groups = near_duplicates(docs, id_col, text_col, **how)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key")).alias("k"))
    keep = _kept(best, groups)
    i, k, g = fresh(docs, "keep_id", "keep_key", "keep_again")
    keep = keep.select(F.col("id").alias(i), F.col("key").alias(k), F.col("again").alias(g))
    got = docs.join(keep, F.col(id_col).eqNullSafe(F.col(i)) & (text_key(text_col) == F.col(k)))
    once = got.where(~F.col(g)).select(*docs.columns)
    more = got.where(F.col(g)).dropDuplicates([i, k]).select(*docs.columns)
    return once.unionByName(more)


def _kept(best: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, key, again) of the kept documents; again: several rows have this id and text."""
    ours = best.select(F.col("k.id").alias("id"), F.col("k.key").alias("key"))
    rows = groups.groupBy("id", "key").agg(F.count(F.lit(1)).alias("rows")).select(F.col("id").alias("i"), F.col("key").alias("j"), "rows")
    return table(ours.join(rows, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("j"))).select("id", "key", (F.col("rows") > 1).alias("again")), "kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of each document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (4-word shingles, 4 bits)."""
    return keep_one(docs, shingle=4, distance=4)
