"""Language-model scoring with Brown class n-grams.

``learn`` counts every word of the training texts and assigns every one of
them to a class. The ``ITEMS`` most frequent words start it: exchange
clustering on the driver, on their pair counts (other words stand there by
their ending: the ``ENDINGS`` most frequent ones, else a common item), moves
each in turn to the class in which the pairs become likeliest. All other words
begin in the class of their ending and are moved on Spark: from (word, class
before or after it, count) each goes to the class in which its occurrences are
likeliest. First the ``CACHE`` most frequent words, by rounds over their pair
counts; then all others, by rounds over their occurrences, where the class of
a neighbour that isn't cached either comes by a join. The score of a text is the sum of
log10 of class transition times word emission, both smoothed; a word that
never occurred in training goes by its ending.

Word counts and classes are a table of any size. The ``CACHE`` most frequent words travel
to the tasks; the other words of a text are looked up by a join, as (row,
word) rows, and texts are scored in blocks with what it found, so nothing that
grows with the corpus passes the driver. In tasks, words are split, numbered
and counted a batch at a time, by Arrow and NumPy."""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import crc_mod, discard, prepare, read, table, text_of

#: Bounds on what passes the driver: words with known counts, words exchanged one by one, endings, classes.
CACHE, ITEMS, ENDINGS, CLASSES = 40_000, 600, 150, 48
ADD, END, SWEEPS = 0.1, b"\n", 8
#: Rounds on Spark over the cached words, and over all others.
ROUNDS, RARE_ROUNDS = 3, 2
#: Tokens, and bytes of words, that a task gathers before it passes them on, and pairs.
FLUSH, FLUSH_BYTES, FLUSH_PAIRS = 6_000_000, 200_000_000, 3_000_000
#: Rows of an Arrow batch that holds words, not texts.
WORD_ROWS = 5000
#: 2 to the power of this: rows whose words outside the cache are scored together.
BLOCK = 7


@contextmanager
def word_batches(spark: SparkSession):
    """For what runs inside it, Arrow batches of WORD_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(WORD_ROWS))
    try:
        yield
    finally:
        prepare(spark)


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Inside it the shuffle files of a query go at its end, not when the driver next collects garbage. For queries that are run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, in UTF-8, A-Z lower-cased, split at ASCII white space; and how many each text has.
    A text's tokens are its words, then the end (a line feed, which no word holds)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    # white space around a text leaves empty words there
    is_word = pc.greater(pc.binary_length(words), 0)
    full = np.r_[0, np.cumsum(is_word.to_numpy(zero_copy_only=False))]
    ends = np.cumsum(sizes)
    return words.filter(is_word).cast(pa.binary()), full[ends] - full[ends - sizes]


def with_ends(x: np.ndarray, sizes: np.ndarray, end: int = 0) -> np.ndarray:
    """``x`` of the words of all texts, with ``end`` after each text."""
    out = np.full(len(x) + len(sizes), end, x.dtype)
    out[np.arange(len(x)) + np.repeat(np.arange(len(sizes)), sizes)] = x
    return out


def packed(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binary values that hold ``sizes`` of the numbers ``values``, one after another: quicker through Spark than arrays."""
    offsets = pa.array(np.r_[0, np.cumsum(sizes)] * values.itemsize, pa.int32())  # an error, should it be too large
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(values.tobytes())])


def unpacked(x: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each of the ``packed`` values holds, and these."""
    _, offsets, data = x.buffers()
    at = np.frombuffer(offsets, np.int32)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int32)
    size = np.dtype(kind).itemsize
    return np.diff(at).astype(np.int64) // size, np.frombuffer(data or b"", kind, (at[-1] - at[0]) // size, at[0])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the column ``text``, words as binary."""

    def count(batches):
        held, ends, n_bytes = [], 0, 0

        def out():
            found = pa.concat_arrays(held).value_counts()
            words, c = pa.concat_arrays([found.field(0), pa.array([END], pa.binary())]), np.r_[found.field(1).to_numpy(), ends]
            return pa.RecordBatch.from_arrays([words, pa.array(c.astype(np.int64))], ["word", "c"])

        for batch in batches:
            words, sizes = words_of(batch.column(0))
            held.append(words)
            ends += len(sizes)
            n_bytes += words.nbytes
            if sum(map(len, held)) > FLUSH or n_bytes > FLUSH_BYTES:
                yield out()
                held, ends, n_bytes = [], 0, 0
        if ends:
            yield out()

    return texts.select(text_of()).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ending(word: bytes) -> bytes:
    """What a word that has no number goes by: its last three bytes, and whether it has bytes above 127."""
    return (b"+" if word.isascii() else b"-") + word[-3:]


def ending_codes(words: pa.Array) -> np.ndarray:
    """The ``ending`` of each word of a binary array, as a number."""
    if not len(words):
        return np.empty(0, np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at -= at[0]
    first, last = at[:-1], at[1:]
    code = np.minimum(last - first, 3)
    for i in (1, 2, 3):
        code = code * 256 + np.where(last - first >= i, data[np.maximum(last - i, 0)], 0)
    above = np.r_[0, np.cumsum(data > 127)]
    return code * 2 + (above[last] == above[first])


class Numbering:
    """Numbers for items: 0 for the end, then words, endings, and one for the rest."""

    def __init__(self, words: list[bytes], endings: list[bytes]):
        self.words = {w: i + 1 for i, w in enumerate(words)} | {END: 0}
        self.first = len(words) + 1
        self.endings = {e: self.first + i for i, e in enumerate(endings)}
        self.rest = self.first + len(endings)
        self.size = self.rest + 1
        self.list = pa.array(words, pa.binary())
        self.codes = ending_codes(pa.array([e[1:] for e in endings], pa.binary())) // 2 * 2 + np.array([e[:1] == b"+" for e in endings], np.int64)
        self.sorted = np.argsort(self.codes)

    def of(self, word: bytes) -> int:
        return i if (i := self.words.get(word)) is not None else self.endings.get(ending(word), self.rest)

    def of_all(self, words: pa.Array) -> np.ndarray:
        """The number of each word of a binary array, by ``of``; no word is the end."""
        ids = pc.fill_null(pc.index_in(words, value_set=self.list), -1).to_numpy().astype(np.int64) + 1
        rare = np.flatnonzero(ids == 0)
        ids[rare] = self.rest
        if rare.size and self.codes.size:
            codes = ending_codes(words.take(pa.array(rare)))
            at = self.sorted[np.minimum(np.searchsorted(self.codes, codes, sorter=self.sorted), self.codes.size - 1)]
            ids[rare] = np.where(self.codes[at] == codes, self.first + at, self.rest)
        return ids


def pair_counts(texts: DataFrame, numbering: Numbering, pack: bool = False) -> DataFrame:
    """(i, at, n): how often (n) items (at) follow item i; a text starts after an end. Rows of lists, or of ``packed`` 32-bit numbers,
    several for an item: as each task has gathered them, so that no pair is shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(numbering)

    def count(batches):
        n, held, size = shared.value, [], 0

        def out():
            at, c = np.unique(np.concatenate(held), return_counts=True)
            i, start = np.unique(at // n.size, return_index=True)
            ends, both = np.r_[start, at.size].astype(np.int32), [x.astype(np.int32) for x in (at % n.size, c)]
            lists = [packed(np.diff(ends), x) if pack else pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in both]
            return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), *lists], ["i", "at", "n"])

        for batch in batches:
            words, sizes = words_of(batch.column(0))
            ids = with_ends(n.of_all(words), sizes)
            held.append(np.r_[0, ids[:-1]] * n.size + ids)
            size += ids.size
            if size > FLUSH_PAIRS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return texts.select(text_of()).mapInArrow(count, "i int, at binary, n binary" if pack else "i int, at array<int>, n array<int>")


def flat(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The first column, once for each entry of its row's lists, and the entries of the lists beside it; they may be ``packed``."""
    if pa.types.is_binary(batch.column(1).type):
        (sizes, at), *more = (unpacked(x, np.int32) for x in batch.columns[1:])
        return [np.repeat(batch.column(0).to_numpy(), sizes), at, *(x for _, x in more)]
    first = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.asarray(batch.column(1).value_lengths()))
    return [first, *(x.flatten().to_numpy(zero_copy_only=False) for x in batch.columns[1:])]


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Exchange clustering: the class of each item, from the item pair counts
    (a square array). Starts with the items dealt out by frequency; the end
    keeps class 0 to itself. Stops when no item moves."""
    n = len(pairs)
    if classes < 3 or n < 3:
        return np.minimum(np.arange(n), 1)
    pairs = pairs.astype(float)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    order = order[order != 0]
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    after, before = pairs @ member, pairs.T @ member  # item -> class after it, before it
    table_ = member.T @ after
    own = np.diag(pairs)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, s = of[w], own[w]
            r, l = after[w].copy(), before[w].copy()
            r[a] -= s
            l[a] -= s
            table_[a] -= r
            table_[:, a] -= l
            table_[a, a] -= s
            # what others have before and after w counts in their totals wherever w goes
            rows, cols, diagonal = table_.sum(1) + l, table_.sum(0) + r, np.diag(table_)
            gain_r, gain_l = xlogx(table_ + r) - xlogx(table_), xlogx(table_ + l[:, None]) - xlogx(table_)
            gain = gain_r.sum(1) - np.diag(gain_r) + gain_l.sum(0) - np.diag(gain_l)
            gain += xlogx(diagonal + r + l + s) - xlogx(diagonal)
            gain -= xlogx(rows + r.sum() + s) - xlogx(rows) + xlogx(cols + l.sum() + s) - xlogx(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table_[b] += r
            table_[:, b] += l
            table_[b, b] += s
            if b != a:
                moved += 1
                of[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[:, a] -= pairs[w]
                before[:, b] += pairs[w]
        if not moved:
            break
    return of


def logs(by: np.ndarray) -> np.ndarray:
    """log10 of the transitions, from the counts of class pairs."""
    return np.log10((by + ADD) / (by.sum(1, keepdims=True) + ADD * len(by)))


def class_pairs(rows: DataFrame, k: int) -> np.ndarray:
    """The k by k sums of ``rows`` (a, b, c)."""
    by = np.zeros((k, k))
    for a, b, c in rows.groupBy("a", "b").agg(F.sum("c").alias("c")).collect():  # bounded by the classes
        by[a, b] = c
    return by


def cells(batches, key, k: int):
    """The batches of (a, b, c): the sums of the numbers with each a * k + b; ``key`` makes both, of a batch's columns as ``flat`` returns them."""
    has = np.zeros(k * k)
    for batch in batches:
        at, n = key(*batch)
        has += np.bincount(at, n, k * k)
    cell = np.flatnonzero(has)
    yield pa.RecordBatch.from_arrays([pa.array((cell // k).astype(np.int32)), pa.array((cell % k).astype(np.int32)), pa.array(has[cell].astype(np.int64))], ["a", "b", "c"])


def pairs_by_class(pairs: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """The k by k counts of class pairs of ``pairs`` (i, at, n); ``of``: the class of each item."""
    shared = pairs.sparkSession.sparkContext.broadcast(of)

    def count(batches):
        of = shared.value
        yield from cells(map(flat, batches), lambda i, at, n: (of[i] * k + of[at], n), k)

    return class_pairs(pairs.mapInArrow(count, "a int, b int, c long"), k)


def place(near: DataFrame, by: np.ndarray, kind: str) -> DataFrame:
    """(word, c, class, x): the class in which each word's occurrences are likeliest, given the counts ``by`` of class pairs.

    ``near``: (word, x, y, z), rows of ``packed`` 64-bit numbers x and y and a number z for a word of type ``kind``: how often (n) its neighbour has a class; ``at`` is the
    class of the one after it, or the number of classes k more for the one before it; the numbers are n * 2k + at. c: how often the word
    occurs; x returned: the word's, in one."""
    k, move, total = len(by), logs(by), by.sum(0)
    # a class without words takes none, the end's class neither
    own = np.where((total > 0) & (np.arange(k) > 0), -np.log10(np.maximum(total, 1) + ADD), -np.inf)
    if not np.isfinite(own).any():
        own[-1] = 0
    shared = near.sparkSession.sparkContext.broadcast((np.vstack([move.T, move]), own))

    def likeliest(batches):
        weight, own = shared.value

        def sums(word, x, size):
            # of no numbers, bincount makes integers
            return np.bincount(word * 2 * k + x % (2 * k), x // (2 * k), size * 2 * k).astype(float).reshape(size, 2 * k)

        def out(words, alone, beside):
            has = alone + beside
            c = has[:, :k].sum(1)
            best = (has @ weight + np.where(c[:, None] > 0, c[:, None], 1) * own).argmax(1)
            word, at = np.nonzero(alone)
            x = packed(np.bincount(word, minlength=len(words)), alone[word, at].astype(np.int64) * 2 * k + at)
            return pa.RecordBatch.from_arrays([words, pa.array(c.astype(np.int64)), pa.array(best.astype(np.int32)), x], ["word", "c", "class", "x"])

        last = None
        for batch in batches:
            words, x, y, z = batch.columns
            # rows of a word stand together; its first is not the word before it
            first = np.r_[True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)][: len(words)]
            if not first.size:
                continue
            words = words.take(pa.array(np.flatnonzero(first)))
            word = np.cumsum(first) - 1
            (n_x, x), (n_y, y), z = unpacked(x, np.int64), unpacked(y, np.int64), z.to_numpy()
            counts = [sums(np.repeat(word, n_x), x, len(words)), sums(np.r_[np.repeat(word, n_y), word], np.r_[y, z], len(words))]
            if last and last[0][0] == words[0]:
                for mine, before in zip(counts, last[1:]):
                    mine[0] += before[0]
            elif last:
                yield out(*last)
            # the last word may go on
            last = [words[-1:], *(x[-1:] for x in counts)]
            yield out(words[:-1], *(x[:-1] for x in counts))
        if last:
            yield out(*last)

    return near.select("word", "x", "y", "z").repartition("word").sortWithinPartitions("word").mapInArrow(likeliest, f"word {kind}, c long, class int, x binary")


def place_cached(pairs: DataFrame, of: np.ndarray, fixed: int, first: int) -> np.ndarray:
    """The classes ``of`` after one round over the cached words from number ``fixed``; ``pairs``: (i, at, n)."""
    k = int(of.max()) + 1
    by = pairs_by_class(pairs, of, k)
    shared = pairs.sparkSession.sparkContext.broadcast(of)

    def gather(batches):
        of, held, size = shared.value, [], 0
        has = np.zeros((first - fixed) * 2 * k, np.int64)

        def add():
            key, n = (np.concatenate(x) for x in zip(*held))
            np.add(has, np.bincount(key, n, has.size).astype(np.int64), out=has)

        for batch in batches:
            i, j, n = flat(batch)
            for word, at in ((i, of[j]), (j, k + of[i])):
                mine = (word >= fixed) & (word < first)
                held.append(((word[mine] - fixed).astype(np.int64) * 2 * k + at[mine], n[mine]))
                size += held[-1][0].size
            if size > FLUSH_PAIRS:
                add()
                held, size = [], 0
        if held:
            add()
        at = np.flatnonzero(has)
        word, start = np.unique(at // (2 * k), return_index=True)
        x = packed(np.diff(np.r_[start, at.size]), has[at] * 2 * k + at % (2 * k))
        yield pa.RecordBatch.from_arrays([pa.array((word + fixed).astype(np.int32)), x], ["word", "x"])

    near = pairs.mapInArrow(gather, "word int, x binary").select("word", "x", F.lit(b"").alias("y"), F.lit(0).cast("long").alias("z"))
    moved = of.copy()
    for r in place(near, by, "int").select("word", "class").collect():  # bounded by the cached words
        moved[r["word"]] = r["class"]
    return moved


def rare_neighbours(texts: DataFrame, numbering: Numbering, of: np.ndarray) -> DataFrame:
    """(word, other, x, y, z) of the words that aren't cached. ``other`` null: how often a neighbour of the word has a class, as in ``place``,
    x of the cached ones, y of the others by the classes of their endings. Else: how often (z) the word stands before ``other``, neither cached."""
    k = int(of.max()) + 1
    shared = texts.sparkSession.sparkContext.broadcast((numbering, of))

    def gather(batches):
        numbering, of = shared.value
        first = numbering.first
        held, n_bytes = [], 0

        def out():
            coded = pa.concat_arrays([words for words, _ in held]).dictionary_encode()
            words, mine = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            left, right = np.concatenate([sides for _, sides in held], 1)
            sides = np.r_[mine * 2 * k + of[right], mine * 2 * k + k + of[left]]
            cached = np.r_[right < first, left < first]
            lists = []
            for which in (cached, ~cached):
                at, n = np.unique(sides[which], return_counts=True)
                lists.append((np.bincount(at // (2 * k), minlength=len(words)), n * 2 * k + at % (2 * k)))
            # a word that isn't cached follows
            p = np.flatnonzero(right >= first)
            double, m = np.unique(mine[p] * len(words) + mine[p + 1], return_counts=True)
            one, two = np.divmod(double, len(words))
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([words, words.take(pa.array(one))]),
                pa.concat_arrays([pa.nulls(len(words), pa.binary()), words.take(pa.array(two))]),
                *(packed(np.r_[sizes, np.zeros(len(double), np.int64)], x.astype(np.int64)) for sizes, x in lists),
                pa.array(np.r_[np.zeros(len(words), np.int64), m]),
            ], ["word", "other", "x", "y", "z"])

        for batch in batches:
            words, sizes = words_of(batch.column(0))
            ids = numbering.of_all(words)
            own = words.filter(pa.array(ids >= first))
            if not len(own):
                continue
            ids = with_ends(ids, sizes)
            at = np.flatnonzero(ids >= first)
            held.append((own, np.stack([np.r_[0, ids[:-1]][at], ids[at + 1]])))  # the last token is the end
            n_bytes += own.nbytes
            if sum(len(w) for w, _ in held) > FLUSH_PAIRS or n_bytes > FLUSH_BYTES:
                yield out()
                held, n_bytes = [], 0
        if held:
            yield out()

    return texts.select(text_of()).mapInArrow(gather, "word binary, other binary, x binary, y binary, z long")


def place_rare(found: DataFrame, by: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(word, c, class) of the words that aren't cached, and the counts of the class pairs with such a word. ``found``: by ``rare_neighbours``."""
    k, none = len(by), F.lit(b"")
    near = found.where("other is null").select("word", "x", "y", "z")
    two, spent = found.where("other is not null").select("word", "other", F.col("z").alias("c")), []
    for _ in range(RARE_ROUNDS):
        placed = table(place(near, by, "binary"), "classes")
        own = placed.select("word", "class").hint("shuffle_hash")
        # neighbours of which neither is cached, by their own classes
        both = two.join(own.withColumnRenamed("class", "a"), "word").join(own.select(F.col("word").alias("other"), F.col("class").alias("b")), "other")
        sides = F.array(F.struct("word", F.col("b").alias("at")), F.struct(F.col("other").alias("word"), (F.col("a") + k).alias("at")))
        beside = both.select("c", F.explode(sides).alias("s")).select("s.word", none.alias("x"), none.alias("y"), (F.col("c") * (2 * k) + F.col("s.at")).alias("z"))
        near = placed.select("word", "x", none.alias("y"), F.lit(0).cast("long").alias("z")).unionByName(beside)
        spent.append(placed)
    discard(*spent[:-1])

    def count(batches):
        def columns(batch):
            sizes, x = unpacked(batch.column(1), np.int64)
            return np.repeat(batch.column(0).to_numpy(), sizes), x

        def sides(own, x):
            at = x % (2 * k)
            return np.where(at < k, own * k + at, (at - k) * k + own), x // (2 * k)

        yield from cells(map(columns, batches), sides, k)

    near = class_pairs(placed.select("class", "x").mapInArrow(count, "a int, b int, c long"), k)
    return placed.drop("x"), near + class_pairs(both.select("a", "b", "c"), k)


class Model:
    """What scoring needs; its size is bounded by CACHE, ENDINGS and CLASSES.

    ``of``: the class of each item; ``by``: counts of class pairs; ``count``: of each cached word; ``kinds``: of each class,
    its words. Each ending stands for one word never seen, in its class. log10 of a token is move[class before, class] +
    log10(c + ADD) + share[class], c: the word's count. ``step`` has the whole of it for cached words, and all but log10(c + ADD) for endings."""

    def __init__(self, numbering: Numbering, of: np.ndarray, by: np.ndarray, count: np.ndarray, kinds: np.ndarray, total: int, distinct: int):
        self.numbering, self.of, self.count, self.total, self.distinct = numbering, of, count, total, distinct
        self.classes, self.first = len(by), numbering.first
        self.move = logs(by)
        unseen = np.bincount(of[self.first :], minlength=self.classes)
        self.share = -np.log10(np.maximum(by.sum(0) + ADD * (kinds + unseen), ADD))
        self.log_count = np.log10(count + ADD)
        self.emit = self.share[of] + np.r_[self.log_count, np.zeros(numbering.size - self.first)]
        self.base = math.log10(total + ADD * (distinct + 1))

    @property
    def step(self) -> np.ndarray:
        return self.move[:, self.of] + self.emit[None, :]

    def of_texts(self, texts: pa.Array) -> pa.Array:
        """Of each text: n_tokens, n_known, base and model sums without what words outside the cache add; these words, how often each, the
        class of its ending; and the class pairs with such a word, one after another: -1 and less for the words, from the first. Numbers of the words ``packed``, 32 bits each."""
        words, sizes = words_of(texts)
        n, first, size = self.numbering, self.first, len(texts)
        ids = n.of_all(words)
        own = words.filter(pa.array(ids >= first)).dictionary_encode()
        ids = with_ends(ids, sizes)
        doc = np.repeat(np.arange(size), sizes + 1)
        known = ids < first
        cached, of_cached = ids[known], doc[known]
        base = np.bincount(of_cached, self.log_count[cached], size) - (sizes + 1) * self.base
        n_known = np.bincount(of_cached[self.count[cached] > 0], minlength=size)
        code = self.of[ids]
        # the distinct words of each text, by text
        key = doc[~known] * max(len(own.dictionary), 1) + own.indices.to_numpy()
        distinct, at, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        of_doc, word = np.divmod(distinct, max(len(own.dictionary), 1))
        many = np.bincount(of_doc, minlength=size)
        start = np.r_[0, np.cumsum(many)[:-1]].astype(np.int64)
        seeds = code[~known][at]
        code[~known] = -1 - (which - start[doc[~known]])
        left = np.r_[0, code[:-1]]  # the end's class
        both = (left >= 0) & (code >= 0)
        score = np.bincount(of_cached, self.emit[cached], size) + np.bincount(doc[both], self.move[left[both], code[both]], size)
        rest = np.stack([left[~both], code[~both]], 1).astype(np.int32).ravel()
        names = ["n_tokens", "n_known", "base", "score", "words", "times", "seeds", "rest"]
        starts = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
        words = pa.ListArray.from_arrays(starts, own.dictionary.take(pa.array(word)))
        columns = [pa.array(sizes + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score)]
        columns += [words, *(packed(many, x.astype(np.int32)) for x in (times, seeds)), packed(2 * np.bincount(doc[~both], minlength=size), rest)]
        return pa.StructArray.from_arrays(columns, names)

    def of_rare(self, docs: pa.Table, found: pa.Table) -> pa.Table:
        """What the words outside the cache add to each text's sums: (of, k, x, y), y in the model's alone; of: its row. ``docs``: (row, times,
        seeds, rest), ``found``: (of, p, c, class) of the words, numbered by p, that occur in training; the others go by their endings."""
        docs = docs.sort_by("row").combine_chunks()
        row, times, seeds, rest = (docs.column(c).combine_chunks() for c in ("row", "times", "seeds", "rest"))
        row, size = row.to_numpy(), len(row)
        (many, of), (_, times), (pairs, pair) = (unpacked(x, np.int32) for x in (seeds, times, rest))
        start, of, pair = np.r_[0, np.cumsum(many)[:-1]].astype(np.int64), of.astype(np.int64), pair.astype(np.int64)
        at = start[np.searchsorted(row, found.column("of").to_numpy())] + found.column("p").to_numpy()
        c = np.zeros(len(of), np.int64)
        c[at], of[at] = found.column("c").to_numpy(), found.column("class").to_numpy()
        word = pair < 0
        pair[word] = of[np.repeat(start, pairs)[word] - 1 - pair[word]]
        doc = np.repeat(np.arange(size), many)
        x = np.bincount(doc, times * np.log10(c + ADD), size)
        y = np.bincount(doc, times * self.share[of], size) + np.bincount(np.repeat(np.arange(size), pairs // 2), self.move[pair[::2], pair[1::2]], size)
        k = np.bincount(doc[c > 0], times[c > 0], size).astype(np.int64)
        return pa.table({"of": row, "k": k, "x": x, "y": y})


def learn(texts: DataFrame, cache: int = CACHE, items: int = ITEMS, endings: int = ENDINGS, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of the column ``text`` of all rows, and the table (word, c, class) of all words."""
    prepare(texts.sparkSession)
    with shuffles_deleted(texts.sparkSession):
        return learned(texts, cache, items, endings, classes)


def learned(texts: DataFrame, cache: int, items: int, endings: int, classes: int) -> tuple[Model, DataFrame]:
    """What ``learn`` returns."""
    spark = texts.sparkSession
    counts = table(word_counts(texts), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(cache).collect()  # bounded
    ends = sum(r["c"] for r in counts.where(F.col("word") == F.lit(END)).collect())
    words = [bytes(r["word"]) for r in top]
    # the most frequent endings of the words that aren't exchanged one by one
    by = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in [*words[:items], END]], "word binary")), "word", "left_anti")
    ascii_ = F.octet_length("word") == F.length(F.decode("word", "UTF-8"))
    by = by.select(F.concat(F.when(ascii_, F.lit(b"+")).otherwise(F.lit(b"-")), F.expr("substring(word, greatest(1, octet_length(word) - 2), 3)")).alias("e"), "c")
    most = [bytes(r["e"]) for r in by.groupBy("e").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(endings).collect()]  # bounded
    numbering, small = Numbering(words, most), Numbering(words[:items], most)
    pairs = table(pair_counts(texts, numbering, pack=True), "pairs")
    # words exchanged one by one, all others as their endings
    to = np.array([small.of(w) for w in [END, *words]] + list(range(small.first, small.size)))
    of = exchange(pairs_by_class(pairs, to, small.size), classes)[to]
    k, fixed = int(of.max()) + 1, min(items, len(words)) + 1
    if fixed < numbering.first:
        with word_batches(spark):
            for _ in range(ROUNDS):
                before, of = of, place_cached(pairs, of, fixed, numbering.first)
                if (of == before).all():
                    break
    count = np.array([ends, *(r["c"] for r in top)], float)
    kinds = np.bincount(of[: numbering.first], count > 0, k)
    named = spark.createDataFrame([(w, int(c), int(o)) for w, c, o in zip([END, *words], count, of) if c > 0], "word binary, c long, class int")
    if distinct <= len(words) + 1:
        by = pairs_by_class(pairs, of, k)
    else:
        found = table(rare_neighbours(texts, numbering, of), "near")
        with word_batches(spark):
            rare, more = place_rare(found, pairs_by_class(pairs, of, k))
        discard(found)
        # pairs of cached words alone: all others have a class of their own, left out
        cached = np.where(np.arange(numbering.size) < numbering.first, of, k)
        by = more + pairs_by_class(pairs, cached, k + 1)[:k, :k]
        for c, m in rare.groupBy("class").count().collect():
            kinds[c] += m
        named = named.unionByName(rare)
    discard(pairs, counts)
    return Model(numbering, of, by, count, kinds, total, distinct), named


def score(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, base_score and score.

    Null text: empty, its one token is the end. Each row is scored by itself,
    repeated ones too. Columns of these names are replaced."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("n_tokens long, n_known long, base double, score double, words array<binary>, times binary, seeds binary, rest binary")
    def of_texts(texts: pa.Array) -> pa.Array:
        return shared.value.of_texts(texts)

    def of_rare(docs: pa.Table, found: pa.Table) -> pa.Table:
        return shared.value.of_rare(docs, found)

    keep = [c for c in docs.columns if c.lower() not in {text_col.lower(), "n_tokens", "n_known", "base_score", "score"}]
    own = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("int")
    # written before the row numbers are used twice: they needn't be the same in a second run
    rows = table(docs.select(F.monotonically_increasing_id().alias("row"), own.alias("own"), of_texts(text_of(text_col)).alias("s")), "scored")
    rare = rows.where(F.size("s.words") > 0).select("row", "s.words", "s.times", "s.seeds", "s.rest")
    words = rare.select(F.col("row").alias("of"), F.posexplode("words").alias("p", "word"))
    found = words.join(counts.hint("shuffle_hash"), "word").select("of", "p", "c", "class")
    block = lambda c: F.shiftright(c, BLOCK).alias(f"{c}_block")
    more = rare.drop("words").groupBy(block("row")).cogroup(found.groupBy(block("of"))).applyInArrow(of_rare, "of long, k long, x double, y double")
    out = rows.select("row", "own", "s.n_tokens", "s.n_known", "s.base", "s.score").join(more, F.col("row") == F.col("of"), "left")
    k, x, y = (F.coalesce(c, F.lit(0)) for c in ("k", "x", "y"))
    return out.select(
        *(F.col("own").getField(c).alias(c) for c in keep),
        "n_tokens", (F.col("n_known") + k).alias("n_known"),
        (F.col("base") + x).alias("base_score"), (F.col("score") + x + y).alias("score"),
    )


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held: Column = crc_mod("doc_id", 10) == 0
    model, counts = learn(docs.where(~held))
    got = score(docs.select("doc_id", held.alias("held_out"), "text"), model, counts)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")
