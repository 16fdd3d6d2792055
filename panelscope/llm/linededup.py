"""Fuzzy line dedup with DataFrame functions only.

A line is trimmed and lower-cased; blank lines don't count. Equal lines are
one line from the start. Each distinct line gets a MinHash signature over its
character shingles, band keys of it bring similar lines together, every
candidate pair is verified by the exact Jaccard similarity of its character
shingles, and distributed union-find joins the verified pairs. Of a component
the first occurrence (by document id and line number) stays.

Signature shingles are those that start a word: a choice by content, so similar
lines choose alike, and a sixth of the work. Lines with fewer than ``FEW`` words
have a second signature, over the shingles at every place that verification
takes, so short lines, those of few long tokens and those without blanks aren't
lost. Verification takes the shingles at every place.

In a bucket each line is first compared with the bucket's least line (by hash).
Where that leaves lines of a large bucket in several components, those outside the bucket's
largest component are compared with ``HUBS`` of its lines, in up to ``ROUNDS`` rounds with other lines of it: of
one family of near copies nearly all then are one component. What is still in several, pairs of lines of
different components, is compared too: all of a bucket where these are no more than
``SMALL`` lines have or than ``EACH`` a line. The lines of the others, such as those of one template or those that
share a passage, meet by their rarest shingles, so many of each line that two similar lines have one in
common, and are compared where what follows it in both can hold enough and where their shingles, folded into a few
bits, don't differ in more bits than similar lines have shingles that differ. So no similar pair of a bucket is left out.

Signatures are made where the lines are read, and only the least values of a
task's lines are shuffled. Of the texts only those in a candidate pair are, told by a bitmap of fixed size (8 MB) that is broadcast;
what it lets through by chance the join after it drops.

Lines go by a 64-bit hash. A second one, 64 bits more, tells where different
lines have the same, and these get a hash of both instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.llm.common import discard, fresh, marked, read, table, text_key, text_of
from panelscope.llm.components import components

#: Characters of a shingle in verification and in signatures; similarity.
SHINGLE, LONG_SHINGLE, SIMILAR = 5, 8, 0.8
#: Values of a signature, and those that each band joins.
MINIMA = 24
BANDS = [tuple(range(4 * b, 4 * b + 4)) for b in range(6)]
#: Lines with fewer words have a signature over all places too.
FEW = 20
#: Bits of the bitmap of candidate lines.
SLOTS = 1 << 26
#: Lines of a bucket, and pairs a line, up to which its pairs are all compared.
SMALL, EACH = 12, 4
#: Lines of a large bucket's largest component that its others are compared with in a round; rounds at most.
HUBS, ROUNDS = 3, 3
#: 64-bit numbers that hold the parities of a line's shingles.
FOLDS = [f"f{i}" for i in range(8)]
BLANKS = " \t\r\x0b\x0c"


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, pos, line, norm) of the lines that aren't blank."""
    d = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), text_of(text_col).alias("text"))
    return d.select("id", "key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("norm", F.lower(F.btrim("line", F.lit(BLANKS)))).where("norm != ''")


def constants(n: int) -> list[int]:
    """n fixed 32-bit numbers, by a multiplicative sequence."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append((x >> 32) - 2**31)
    return out


def signatures(lines: DataFrame) -> DataFrame:
    """(a, bands): band keys of the lines (a, norm), which may repeat; a row for each of a line's one or two signatures. The halves
    of a shingle's hash are two hash functions; each value is the minimum of one of them mixed with a constant."""
    words = F.split("norm", " ")
    starts = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda w, v: F.substring(F.concat(w, F.lit(" "), F.coalesce(v, F.lit(""))), 1, LONG_SHINGLE))
    every = F.when(F.size(words) < FEW, pieces("norm")).otherwise(F.array().cast("array<string>"))
    # two lists a line, not one with its length: that would be taken anew for each shingle
    both = F.array(F.struct(F.lit(False).alias("every"), starts.alias("g")), F.struct(F.lit(True).alias("every"), every.alias("g")))
    lists = lines.select("a", F.explode(both).alias("x")).select("a", "x.every", F.col("x.g").alias("gs"))
    grams = lists.select("a", "every", F.explode("gs").alias("g")).select("a", "every", F.xxhash64("g").alias("h"))
    m = minima(grams, ["a", "every"], constants(MINIMA))
    return m.select("a", F.array(*(F.xxhash64(F.lit(b), "every", *(F.col(f"m{k}") for k in ks)) for b, ks in enumerate(BANDS))).alias("bands"))


def minima(grams: DataFrame, by: list[str], mixed: list[int]) -> DataFrame:
    """``by`` and m0, m1, ...: for each constant the least of the shingles' hashes ``h`` mixed with it."""
    halves = grams.select(*by, F.shiftright("h", 32).cast("int").alias("h0"), F.shiftright(F.shiftleft("h", 32), 32).cast("int").alias("h1"))
    return halves.groupBy(*by).agg(*(F.min(F.col(f"h{k % 2}").bitwiseXOR(F.lit(c))).alias(f"m{k}") for k, c in enumerate(mixed)))


def among(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose ``a`` is in ``ids``, and few others: by a bitmap of SLOTS bits, whatever the number of ids."""
    slot = F.pmod("a", F.lit(SLOTS)).cast("long")
    bits = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    at = lines.withColumn("s", slot).withColumn("bucket", F.bitmap_bucket_number("s")).join(F.broadcast(bits), "bucket")
    place = F.bitmap_bit_position("s")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(s) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return at.where(byte.bitwiseAND(F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int")) > 0).select(*lines.columns)


def pieces(norm: str) -> Column:
    """The character shingles at every place; of a shorter line, the line."""
    return F.when(F.length(norm) < SHINGLE, F.array(norm)).otherwise(F.regexp_extract_all(norm, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1)))


def shingles(norm: str) -> Column:
    """The hashes of the distinct character shingles."""
    return F.array_distinct(F.transform(pieces(norm), lambda g: F.xxhash64(g)))


def verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose texts have the Jaccard similarity ``similar`` or more. ``texts``: (a, norm), distinct."""
    other = texts.select(F.col("a").alias("b"), F.col("norm").alias("norm2"))
    both = pairs.join(texts.select("a", "norm"), "a").join(other, "b")
    # one expression, so that a filter pushed down takes each line's shingles once
    sets = F.array(F.struct(shingles("norm").alias("s"), shingles("norm2").alias("t")))
    common = F.transform(sets, lambda x: F.struct(F.size(F.array_intersect(x["s"], x["t"])).alias("n"), (F.size(x["s"]) + F.size(x["t"])).alias("all")))
    return both.where(F.exists(common, lambda x: x["n"] >= similar * (x["all"] - x["n"]))).select(*pairs.columns)


def cross(buckets: DataFrame) -> DataFrame:
    """(a, b, c, d): pairs of lines of different components in one bucket of (k, a, c), once each; of buckets by
    ``prefixed`` those that can be similar."""
    by_prefix = "room" in buckets.columns
    more = ["room", "need", "spare", *FOLDS] if by_prefix else []
    # of each pair one line isn't of the bucket's largest component: only those are joined with all
    most = buckets.groupBy("k", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("k").agg(F.max_by("c", F.struct("m", "c")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    marked_ = buckets.join(most, "k").select("k", "a", "c", *more, (F.col("c") != F.col("most")).alias("rest"))
    other = marked_.select("k", F.col("a").alias("b"), F.col("c").alias("d"), F.col("rest").alias("rest_2"), *(F.col(x).alias(f"{x}_2") for x in more))
    can = F.lit(True)
    if by_prefix:
        differ = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"{f}_2"))) for f in FOLDS), F.lit(0))
        can = (F.least("room", "room_2") >= F.col("need") + F.col("need_2") - 1e-9) & (differ <= F.col("spare") + F.col("spare_2") + 1e-9)
    pairs = marked_.where("rest").join(other, "k").where(F.expr("c != d and (a < b or not rest_2)") & can)
    turned = F.col("a") > F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("d")).otherwise(F.col("c")).alias("c"), F.when(turned, F.col("c")).otherwise(F.col("d")).alias("d")).distinct()


def folded(grams: DataFrame) -> DataFrame:
    """(a, f0, f1, ...): the shingles ``k`` of each line, distinct, folded into bits, each the parity of those that fall on it.
    Where two lines differ in a bit, one has a shingle that the other hasn't."""
    at = F.pmod("k", F.lit(len(FOLDS)))
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(k, {(len(FOLDS) - 1).bit_length()}), 64) as int))")
    return grams.groupBy("a").agg(*(F.bit_xor(F.when(at == i, bit).otherwise(F.lit(0).cast("long"))).alias(f) for i, f in enumerate(FOLDS)))


def prefixed(lines: DataFrame, similar: float) -> DataFrame:
    """(k, a, c, room, need, spare, f0, f1, ...): the rarest shingles ``k`` of each line of (a, c, norm), so many that two lines of the similarity
    ``similar`` or more have one in common; how many of the line's shingles are no rarer, its part of the number that both must share and
    of the number that may be in one alone; and its shingles ``folded``."""
    grams = table(lines.select("a", "c", shingles("norm").alias("s")).select("a", "c", F.size("s").alias("n"), F.explode("s").alias("k")), "grams")
    times = grams.groupBy("k").agg(F.count(F.lit(1)).alias("times"))
    placed = grams.join(times, "k").withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("times", "k")))
    few = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(similar) - 1e-9) + 1).where("times > 1")
    room, part = F.col("n") - F.col("place") + 1, lambda x: F.col("n") * F.lit(x / (1 + similar))
    few = few.select("k", "a", "c", room.alias("room"), part(similar).alias("need"), part(1 - similar).alias("spare"))
    found = table(few.join(folded(grams), "a"), "prefixes")
    discard(grams)
    return found


def sized(buckets: DataFrame) -> DataFrame:
    """The buckets of (k, a, c) with lines of several components, and whether their ``cross`` pairs are few: at most
    those of SMALL lines, or EACH a line, as where all but a few lines are of one component."""
    by = buckets.groupBy("k", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("k").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("own"), F.count(F.lit(1)).alias("comps"))
    few = F.col("n") * F.col("n") - F.col("own") <= 2 * F.greatest(F.lit(SMALL * (SMALL - 1) // 2), EACH * F.col("n"))
    return buckets.join(by.where("comps > 1").select("k", few.alias("few")), "k")


def hubs(buckets: DataFrame, seed: int) -> DataFrame:
    """(a, b, c, d): the lines of those buckets (k, a, c) that are still large, but those of their bucket's largest component, each with HUBS
    lines of that component, others for another ``seed``."""
    large = table(sized(buckets).where("not few").select("k", "a", "c"), "large")
    most = large.groupBy("k", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("k").agg(F.max_by("c", F.struct("m", "c")).alias("d"))
    least = [F.min_by("a", F.xxhash64(F.lit(seed * HUBS + i), "a")) for i in range(HUBS)]
    chosen = large.join(most, "k").where("c = d").groupBy("k", "d").agg(F.array_distinct(F.array(*least)).alias("bs"))
    # the same two lines may meet in several buckets
    found = table(large.join(chosen, "k").where("c != d").select("a", F.explode("bs").alias("b"), "c", "d").distinct(), "hubs")
    discard(large)
    return found


def grown(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) with the components that ``links`` (c, d) link joined; a line without a link is its own component."""
    over = table(components(links, "c", "d"), "over")
    up = over.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    named = groups.join(up, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    # lines that had no link before
    alone = over.join(groups, "node", "left_anti").select("node", "component")
    found = table(named.unionByName(alone), "groups")
    discard(over)
    return found


def apart(buckets: DataFrame, texts: DataFrame, similar: float = SIMILAR, more: DataFrame | None = None) -> DataFrame:
    """(a, b, c, d): pairs of lines of different components to be compared, of the buckets (k, a, c); ``texts``: (a, norm).
    ``more``: (a, c) of lines that are to meet by their rarest shingles like those of large buckets."""
    now = table(sized(buckets), "open")
    pairs, spent = cross(now.where("few").select("k", "a", "c")), [now]
    large = now.where("not few").select("a", "c")
    large = (large if more is None else large.unionByName(more)).distinct()
    if not large.isEmpty():
        spent.append(prefixed(texts.join(large, "a"), similar))
        pairs = pairs.unionByName(cross(spent[-1]))
    found = table(pairs.distinct(), "apart")
    discard(*spent)
    return found


def joined(lines: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, component) of the distinct lines that are similar to another.
    ``lines``: (a, norm), rows may repeat."""
    signed = table(signatures(lines), "bands")
    bands = signed.select("a", F.explode("bands").alias("k"))
    ends = table(bands.groupBy("k").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "ends")
    # by a bitmap first: most keys stand alone, and needn't be shuffled again
    bands = marked(bands, ends, "k", "met").where("met").drop("met")
    met = table(bands.join(ends, "k").select("k", "a", "b", "n"), "met")
    discard(signed, ends)
    pairs = table(met.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    ids = table(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct(), "ids")
    texts = among(lines, ids).groupBy("a").agg(F.first("norm").alias("norm"))
    texts = table(texts.join(ids, "a", "left_semi"), "texts")
    groups = table(components(verified(pairs, texts, similar)), "groups")
    discard(pairs, ids)
    # the lines of buckets that have several components beside the line that all were compared with
    shared = met.where("n > 2").select("k", "a")

    def of_groups(lines):
        of = groups.select(F.col("node").alias("a"), F.col("component").alias("c"))
        return lines.join(of, "a", "left").withColumn("c", F.coalesce("c", "a"))

    large = table(sized(of_groups(shared)).where("not few").select("k", "a"), "first_large")
    for seed in range(ROUNDS):
        near = hubs(of_groups(large), seed)
        links = table(verified(near, texts, similar).select("c", "d").distinct(), "near")
        none = links.isEmpty()
        if not none:
            done, groups = groups, grown(groups, links)
            discard(done)
        discard(near, links)
        if none:
            break
    left = apart(of_groups(shared), texts, similar, of_groups(large.select("a").distinct()))
    found = grown(groups, verified(left, texts, similar).select("c", "d"))
    discard(groups, met, texts, left, large)
    return found


def clashing(at: DataFrame) -> DataFrame | None:
    """(a) of the hashes that different lines of (a, a2) share, if there are any."""
    both = at.groupBy("a").agg(F.min("a2").alias("x"), F.max("a2").alias("y"))
    clash = table(both.where("x != y").select(F.col("a").alias("clash")), "clash")
    return None if clash.isEmpty() else clash


def told_apart(lines: DataFrame, clash: DataFrame | None) -> DataFrame:
    """``lines`` (a, a2, ...) with a hash of both as ``a`` where the first is shared."""
    if clash is None:
        return lines
    again = lines.join(clash, F.col("a") == F.col("clash"), "left")
    return again.withColumn("a", F.when(F.col("clash").isNotNull(), F.xxhash64("a", "a2")).otherwise(F.col("a"))).drop("clash")


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(id, key, pos, first, kept) of each line that isn't blank: its document's
    id and text key, its number from 0, the place (id, key, pos) of the first line of its component, and whether it is that line.

    Null and empty texts have no lines. Null ids come last in the order.
    Rows that repeat both id and text are the same document: their lines get equal answers."""
    lines = lines_of(docs, id_col, text_col).withColumns({"a": F.xxhash64("norm"), "a2": F.xxhash64(F.lit(11), "norm")})
    at = table(lines.select("id", "key", "pos", "a", "a2"), "lines")
    clash = clashing(at)
    at, lines = told_apart(at, clash), told_apart(lines, clash)
    groups = joined(lines.select("a", "norm"), similar)
    of = at.join(groups.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("c", F.coalesce("component", "a"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "pos")
    first = of.groupBy("c").agg(F.min(place).alias("first"))
    got = of.join(first, "c")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos"))
    return got.select("id", "key", "pos", "first", same.alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with each text reduced to its kept and blank lines. Documents
    that lose all their lines go; those that had none stay. Columns stay as they are."""
    i, k, g, n = fresh(docs, "line_id", "line_key", "line_gone", "line_kept")
    all_ = classed(docs, id_col, text_col, similar)
    lost = all_.groupBy(F.col("id").alias(i), F.col("key").alias(k)).agg(F.collect_set(F.when(~F.col("kept"), F.col("pos"))).alias(g), F.max("kept").alias(n)).where(F.size(g) > 0)
    got = docs.join(lost, F.col(id_col).eqNullSafe(F.col(i)) & (text_key(text_col) == F.col(k)), "left").where(F.coalesce(F.col(n), F.lit(True)))
    rest = F.expr(f"array_join(filter(split(`{text_col}`, '\\n', -1), (x, i) -> not array_contains(`{g}`, i)), '\\n')")
    return got.withColumn(text_col, F.when(F.col(g).isNull(), F.col(text_col)).otherwise(rest)).select(*docs.columns)


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, component_doc_id, component_line_no, kept of each line that isn't blank."""
    got = classed(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.col("pos").alias("line_no"), F.col("first.id").alias("component_doc_id"), F.col("first.pos").alias("component_line_no"), "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat go, and n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
