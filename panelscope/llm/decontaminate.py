"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of ``n`` words form the hash set. Each window has an
anchor, its longest word; a document's word windows are looked at only where
an anchor stands (the anchors' hashes are a set inside the filter expression),
and each such window is then verified by its words in a broadcast hash join.

The set is dealt in blocks of at most ``BLOCK`` windows, whatever the
benchmark's size: one block's anchors and windows are all that is in the plan
or broadcast at a time, and each block scans the documents once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import fresh, read, table, text_key, text_of

#: Windows of one broadcast: at most some 20 MB at 100 bytes a window.
BLOCK = 100_000
#: Word characters before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words, A-Z lower-cased (other letters stay as they are)."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)),
    )


def windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, len, anchor, items): each distinct window of the benchmark, its
    words joined by a space, and the ids of the items that hold it, as text."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(text_of(text_col)).alias("w")).where("size(w) > 0")
    at = F.expr(f"transform(sequence(0, greatest(size(w) - {n}, 0)), i -> slice(w, i + 1, {n}))")
    one = items.select("item", F.explode(at).alias("w")).select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("len"), F.expr("array_max(transform(w, x -> struct(length(x) as l, x as x))).x").alias("anchor"))
    return one.groupBy("window", "len", "anchor").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", block: int = BLOCK, bench_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """(key, found) for each text with a window of the benchmark: the text's
    128-bit key and its hits (s: first word, len, items), by position. Copies
    of a text are one row. Null and empty texts and items have no windows."""
    grams = table(windows(benchmark, n, bench_id, bench_text), "windows")
    parts = max(1, math.ceil(grams.count() / block))
    grams = grams.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts)))
    docs = docs.select(text_key(text_col).alias("key"), words_of(text_of(text_col)).alias("w"))
    out = None
    for k in range(parts):
        mine = grams.where(F.col("part") == k)
        anchors = [r[0] for r in mine.select(F.xxhash64("anchor")).distinct().collect()]  # at most one a window of the block
        lens = [r[0] for r in mine.select("len").distinct().collect()]  # 1 to n
        if not anchors:
            continue
        at = F.expr(f"if(size(w) = 0, array(), filter(sequence(0, size(w) - 1), i -> xxhash64(get(w, i)) in ({', '.join(f'{a}L' if a > -(2**63) else '(-9223372036854775807L - 1L)' for a in anchors)})))")
        near = F.concat(*(F.expr(f"if(size(w) < {m}, array(), transform(array_distinct(flatten(transform(at, i -> sequence(greatest(0, i - {m - 1}), least(i, size(w) - {m}))))), s -> struct(s, {m} as len)))") for m in sorted(lens)))
        # no filter on ``at``: pushed down, it would take the words anew for each word
        seen = docs.withColumn("at", at).select("key", F.explode(F.transform(near, lambda x: F.struct(x["s"].alias("s"), x["len"].alias("len"), F.array_join(F.slice("w", x["s"] + 1, x["len"]), " ").alias("window")))).alias("x"))
        got = seen.select("key", "x.s", "x.window").join(F.broadcast(mine.select("window", "len", "items")), "window").select("key", "s", "len", "items")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = docs.where("false").select("key", F.lit(0).alias("s"), F.lit(0).alias("len"), F.array(F.lit("")).alias("items"))
    return out.distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "len", "items"))).alias("found"))


def measured(found: DataFrame) -> DataFrame:
    """(key, found, n_hit, items): words inside a hit, and the sorted ids of the items."""
    n_hit = F.expr("aggregate(found, struct(0 as e, 0L as n), (a, x) -> struct(greatest(a.e, x.s + x.len) as e, a.n + greatest(0, x.s + x.len - greatest(a.e, x.s)) as n), a -> a.n)")
    return found.select("key", "found", n_hit.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("found.items"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = 10, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without benchmark passages. mode "document": documents with a
    hit go. "span": the hit words go, each with the separator after it, and
    all else stays as it is.

    Null and empty texts stay; repeated rows are treated alike; columns stay
    as they are. An empty benchmark removes nothing."""
    found = table(measured(hits(docs, benchmark, n, text_col, **how)), "hits")
    key, spans = fresh(docs, "hit_key", "hit_spans")
    found = found.select(F.col("key").alias(key), F.col("found").alias(spans))
    on = text_key(text_col) == F.col(key)
    if mode == "document":
        return docs.join(found, on, "left_anti")
    if mode != "span":
        raise ValueError("mode is document or span")
    got = docs.join(found, on, "left")
    text = text_of(text_col)
    w, sep, at = fresh(got, "span_words", "span_seps", "span_gone")
    got = got.withColumn(w, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    got = got.withColumn(sep, F.split(text, WORD, -1))
    got = got.withColumn(at, F.expr(f"array_distinct(flatten(transform(`{spans}`, x -> sequence(x.s, x.s + x.len - 1))))"))
    kept = F.expr(f"concat(get(`{sep}`, 0), array_join(transform(`{w}`, (x, i) -> if(array_contains(`{at}`, i), '', concat(x, get(`{sep}`, i + 1)))), ''))")
    return got.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = measured(hits(docs, read(spark, sf_dir, "benchmark"))).select("key", "n_hit", "items")
    ours = docs.select("doc_id", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("n_words"), text_key().alias("key"))
    got = ours.join(table(found, "hits"), "key", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return got.select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


#: op3_decontaminate in SQL: windows as joined words, matched by equality.
SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i + 1 : i + 10], ' ') AS g FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
d AS (SELECT r, i, m, array_to_string(w[i + 1 : i + m], ' ') AS g FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM dw, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
h AS (SELECT r, i, d.m, item FROM d JOIN b USING (m, g)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)"""
