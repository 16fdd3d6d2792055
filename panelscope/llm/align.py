"""Alignment of two tokenizers over the same bytes.

A (byte-level BPE, JSON) and B (sentencepiece BPE with byte fallback) both
encode a space and the text. Where a token of A and one of B end at the same
byte, both sequences are cut: the cuts make groups. A token of A and one of B
are linked if their bytes overlap.

A task works on chunks of whole texts with Arrow's kernels: lists are flattened
with their parent's index, byte lengths summed up within each document, the
ends of both sides met by a full outer hash join on (document, end). Each row of
that join is one link: what lies between two neighbouring ends belongs to one
token on either side, so missing sides are filled from the next row. A chunk's
links are counted by id pair, and Spark sums these counts over all chunks.

A chunk leaves one row for each document, whose links are numbers into the
chunk's list of distinct pairs, and one row with that list. Only those lists are
shuffled to meet the corpus counts: a pair has one row a chunk, however
frequent it is. Then documents and counts of a chunk meet by a cogroup. The
chunks are a table in the shared folder, so a lost task finds them unchanged."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.llm import bpe
from panelscope.llm.common import prepare, read, table

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK, SLICE = 4 << 20, 1 << 20
#: Runs of white space that overflow the stack of the faster encoder; texts with them go to the other one.
LONG_RUN = re.compile(r"\s{2000}")


class Sides:
    """Both tokenizers of a worker process, and the bytes of their tokens by id."""

    def __init__(self, a_file: str, b_file: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        import tokenizers

        spec = bpe.parse(a_file)
        ranks = {v: i for i, v in spec["strings"].items() if i not in spec["added"].values()}
        if spec["prefix_space"] or any(new != 256 + rank for rank, new in enumerate(spec["made"])):
            raise ValueError("tokenizer A must have ids in the order of its merges and no prefix space")
        self.fast = tiktoken.Encoding("a", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = tokenizers.Tokenizer.from_str(a_file)
        self.slow.encode_special_tokens = True
        self.slow.no_truncation()
        self.slow.no_padding()
        self.b = b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = {
            "a": pa.array([spec["strings"].get(i, b"") for i in range(max(spec["strings"]) + 1)], pa.binary()),
            "b": pa.array([piece(i) for i in range(b.get_piece_size())], pa.binary()),
        }
        self.length = {k: pc.binary_length(v).cast(pa.int64()) for k, v in self.bytes.items()}
        self.name = {k: pa.array(map(str, range(len(v))), pa.string()) for k, v in self.bytes.items()}

    def encode(self, texts: list[str]) -> dict[str, pa.ListArray]:
        a = [np.array(self.slow.encode(f" {t}", add_special_tokens=False).ids) if LONG_RUN.search(t) else self.fast.encode_to_numpy(f" {t}") for t in texts]
        b, part, size = [], [], 0
        for n, t in enumerate(texts):
            part.append(t)
            size += len(t)
            if size >= SLICE or n == len(texts) - 1:
                b += [np.array(ids, np.int32) for ids in self.b.encode(part, num_threads=1)]
                part, size = [], 0
        return {"a": listed(a), "b": listed(b)}


def listed(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def before(counts: pa.Array) -> pa.Array:
    """Running sums with 0 before the first: one more than ``counts``."""
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts.cast(pa.int64()))])


def ends(ids: pa.ListArray, length: pa.Array, side: str) -> pa.Table:
    """(doc, end, id) of each token: the document's number and the byte of it at which the token ends."""
    flat, doc = ids.flatten(), pc.list_parent_indices(ids)
    total = before(length.take(flat))
    end = pc.subtract(total.slice(1), total.take(ids.offsets).take(doc))
    return pa.table({"doc": doc, "end": end, side: flat})


def grouped(rows: pa.Table, n_docs: int, name: dict[str, pa.Array]) -> pa.Array:
    """`a1,a2|b1;...` of each document, from the joined ends in order."""
    a, b = pc.is_valid(rows["a"]), pc.is_valid(rows["b"])
    cut = pc.and_(a, b)
    sides = []
    for side, there in (("a", a), ("b", b)):
        last = pc.cumulative_sum(there.cast(pa.int32())).filter(cut).combine_chunks()
        ids = name[side].take(rows[side].filter(there).combine_chunks())
        sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), last]), ids), ","))
    groups = pc.binary_join_element_wise(*sides, "|")
    n = np.bincount(rows["doc"].filter(cut).to_numpy(), minlength=n_docs)
    return pc.binary_join(pa.ListArray.from_arrays(before(pa.array(n)).cast(pa.int32()), groups), ";")


def batch_of(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of ``schema``; columns that aren't given are null."""
    flat = lambda c: pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    return pa.RecordBatch.from_arrays([flat(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def chunk_rows(ids: pa.Array, texts: list[str], chunk: int, sides: Sides, keep: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows a chunk leaves: one for each text, one with the distinct pairs."""
    lists = sides.encode(texts)
    whole = pa.array([f" {t}".encode() for t in texts], pa.binary())
    right = pa.array([bool(t) for t in texts], pa.bool_())
    for side, v in lists.items():
        joined = pc.binary_join(pa.ListArray.from_arrays(v.offsets, sides.bytes[side].take(v.flatten())), b"")
        right = pc.and_(right, pc.equal(joined, whole))
    lists = {side: v.filter(right) for side, v in lists.items()}
    n_docs = len(lists["a"])
    a, b = (ends(lists[s], sides.length[s], s) for s in ("a", "b"))
    rows = a.join(b, keys=["doc", "end"], join_type="full outer", use_threads=False).sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    cut = pc.and_(pc.is_valid(rows["a"]), pc.is_valid(rows["b"]))
    groups = grouped(rows, n_docs, sides.name)
    a_id, b_id = (pc.fill_null_backward(rows[s]).cast(pa.int64()) for s in ("a", "b"))
    pair = pa.concat_arrays(pc.bit_wise_or(pc.shift_left(a_id, pa.scalar(32, pa.int64())), b_id).chunks or [pa.array([], pa.int64())]).dictionary_encode()
    links = pa.table({"doc": rows["doc"], "pair": pair.indices}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    counts = links.group_by("pair", use_threads=False).aggregate([("count_all", "sum")]).sort_by("pair")
    n_of = lambda doc: pa.array(np.bincount(doc.to_numpy(), minlength=n_docs).astype(np.int64))
    own = before(n_of(links["doc"])).cast(pa.int32())
    one = lambda c: pa.concat_arrays(c.chunks or [pa.array([], c.type)])
    found = pa.table({
        "place": np.flatnonzero(right.to_numpy(zero_copy_only=False)),
        "n_a": lists["a"].value_lengths(), "n_b": lists["b"].value_lengths(), "n_groups": n_of(rows["doc"].filter(cut)), "n_links": n_of(rows["doc"]),
        "groups_sha256": pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in groups], pa.string()),
        "groups": groups if keep else pa.nulls(n_docs, pa.string()),
    })
    # a text without tokens has empty lists
    width = np.zeros(len(texts) + 1, np.int32)
    width[1:][right.to_numpy(zero_copy_only=False)] = np.diff(own.to_numpy())
    at = pa.array(np.cumsum(width, dtype=np.int32))
    docs = pa.table({"place": np.arange(len(texts))}).join(found, "place", use_threads=False).sort_by("place")
    number = pa.array([chunk], pa.int64())
    yield batch_of(
        schema, len(texts), chunk=pa.array([chunk] * len(texts), pa.int64()), id=ids, groups_sha256=pc.fill_null(docs["groups_sha256"], ""), groups=pc.fill_null(docs["groups"], "") if keep else docs["groups"],
        pair=pa.ListArray.from_arrays(at, one(links["pair"])), times=pa.ListArray.from_arrays(at, one(links["count_all"]).cast(pa.int32())),
        **{c: pc.fill_null(docs[c], 0) for c in ("n_a", "n_b", "n_groups", "n_links")},
    )
    whole_list = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    yield batch_of(schema, 1, chunk=number, key=whole_list(pair.dictionary), total=whole_list(one(counts["count_all_sum"])))


CHUNKS = "chunk bigint, id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pair array<int>, times array<int>, key array<bigint>, total array<bigint>"


def chunks(docs: DataFrame, a_file: str, b_file: str, text_col: str = "text", id_col: str = "doc_id", keep_groups: bool = False) -> DataFrame:
    """The table of chunks of ``docs``: a row for each document with its counts,
    its groups (their digest, and their text if ``keep_groups``) and its pairs as
    numbers into the chunk's list (``pair``, ``times``); and one for each chunk with the
    list itself (``key``: A's id times 2^32 plus B's; ``total``: links in the chunk).

    A text that is null or empty, or whose tokens' joined bytes on either side differ from a space and the
    text, has no tokens: zeros, no pairs, an empty digest. Null ids stay null,
    repeated rows stay rows of their own, other columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:  # on the driver; vocabulary files have a few MB
        shared = spark.sparkContext.broadcast((a.read(), b.read()))
    kind = docs.schema[id_col].dataType
    out, most = T.StructType.fromDDL(CHUNKS.format(id=kind.simpleString())), CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, sides = to_arrow_schema(out), None
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sides
            sides = sides or Sides(*shared.value)
            yield from chunk_rows(pa.concat_arrays(ids), texts, number, sides, keep_groups, schema)

        for batch in batches:
            start, got = 0, batch["text"]
            for n in range(batch.num_rows):
                t = got[n].as_py() or ""
                texts.append(t)
                size += len(t)
                if size >= most:
                    ids.append(batch["id"].slice(start, n + 1 - start))
                    yield from flush()
                    number, start, ids, texts, size = number + 1, n + 1, [], [], 0
            if start < batch.num_rows:
                ids.append(batch["id"].slice(start))
        if texts:
            yield from flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(key, count) over all chunks: how many links hold the pair of ids."""
    each = parts.where("key is not null").select(F.explode(F.arrays_zip("key", "total")).alias("p"))
    return each.groupBy(F.col("p.key").alias("key")).agg(F.sum("p.total").alias("count"))


def summed(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents' rows of ``parts`` with ``n_best`` (links whose count is the
    highest of their B id) and ``count_sum``, and without the lists of pairs."""
    b_id = F.col("key").bitwiseAND(0xFFFFFFFF)
    # one row for each id of B's vocabulary at most, whatever the corpus
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("top"))
    known = counts.join(F.broadcast(highest), b_id == F.col("b")).select("key", "count", (F.col("count") == F.col("top")).alias("best"))
    lists = parts.where("key is not null").select(F.col("chunk").alias("of"), F.posexplode("key").alias("pos", "key"))
    looked = lists.join(known, "key").select("of", "pos", "count", "best")
    docs = parts.where("key is null").drop("key", "total")
    kept = [f for f in docs.schema if f.name not in ("pair", "times")]
    out = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def add(docs: pa.Table, looked: pa.Table) -> pa.Table:
        looked, docs = looked.sort_by("pos"), docs.combine_chunks()
        n = docs.num_rows
        pair, times = (pa.concat_arrays(docs[c].chunks) if n else pa.array([], pa.list_(pa.int32())) for c in ("pair", "times"))
        doc, at = pc.list_parent_indices(pair), pair.flatten()
        times = times.flatten().cast(pa.int64())
        both = pa.table({
            "doc": doc,
            "count_sum": pc.multiply(times, looked["count"].take(at)),
            "n_best": pc.multiply(times, looked["best"].cast(pa.int64()).take(at)),
        }).group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
        got = pa.table({"doc": np.arange(n)}).join(both, "doc", use_threads=False).sort_by("doc")
        sums = [pc.fill_null(got[f"{c}_sum"], 0) for c in ("n_best", "count_sum")]
        return pa.Table.from_arrays([*(docs[f.name] for f in kept), *sums], names=[f.name for f in out])

    return docs.groupBy("chunk").cogroup(looked.groupBy("of")).applyInArrow(add, out)


def align(docs: DataFrame, a_file: str, b_file: str, text_col: str = "text", id_col: str = "doc_id", keep_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): each document's ``id``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` and ``groups``
    (`a1,a2|b1;a3|b2`: ids of either side, group by group; null unless
    ``keep_groups``); and ``a``, ``b``, ``count`` of each linked pair of ids.
    For odd texts see ``chunks``. An empty table gives two empty ones."""
    parts = table(chunks(docs, a_file, b_file, text_col, id_col, keep_groups), "chunks")
    counts = table(pair_counts(parts), "pairs")
    pairs = counts.select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count")
    return summed(parts, counts).drop("chunk"), pairs


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts of tokens, groups and links, and groups_sha256 of each whole document."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got, _ = align(docs, bpe.tokenizer_path(), bpe.tokenizer_path("piece_bpe_32k.model"), keep_groups=False)
    return got.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
