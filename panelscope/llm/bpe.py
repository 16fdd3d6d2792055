"""BPE encoding and decoding.

Encoding splits a text at the tokenizer's added tokens, then by its pattern
into pieces, and merges the bytes of each piece: the symbols form a doubly
linked list, a heap holds the adjacent pairs by merge rank, and entries whose
symbols have meanwhile gone are skipped when they come up. Decoding
concatenates the vocabulary's strings.

A piece's ids depend on nothing around it, so each Python worker keeps the ids
of the pieces it has met lately (at most ``CACHE`` in each of two generations).
No shuffle; a lost task is simply run again."""

from __future__ import annotations

import json
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import fresh, prepare, read

#: Fixed value: the pattern by which byte-level vocabularies of this kind split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, LONG = 300_000, 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def parse(text: str) -> dict:
    """What encoding and decoding need of a tokenizer file (JSON, byte-level BPE)."""
    spec = json.loads(text)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("only byte-level BPE files without a normalizer are supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that strip or match single words are not supported")
    letters = byte_letters()
    byte_of = {c: b for b, c in letters.items()}
    vocab = model["vocab"]
    strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if all(c in byte_of for c in s)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings |= {i: s.encode() for s, i in added.items()}
    ranks, made = {}, []
    for rank, m in enumerate(model["merges"]):
        x, y = m if isinstance(m, list) else m.split(" ")
        ranks[vocab[x], vocab[y]] = rank
        made.append(vocab[x + y])
    return {"bytes": [vocab[letters[b]] for b in range(256)], "ranks": ranks, "made": made, "strings": strings, "added": added, "prefix_space": bool(pre.get("add_prefix_space"))}


PLACE = (1 << 40) - 1


def merge(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """The ids left after all merges, lowest rank first, leftmost first among
    equals. ``ranks`` has the rank of each pair of ids that merges, ``made`` the
    id that each rank makes. A heap entry is a rank and, in its lower 40 bits, the place of the pair's left symbol."""
    n, rank_of = len(symbols), ranks.get
    heap = [(rank << 40) + i for i, rank in enumerate(map(rank_of, zip(symbols, symbols[1:]))) if rank is not None]
    if not heap:
        return symbols
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    symbols.append(-1)  # after the last: pairs with no symbol
    while heap:
        entry = heappop(heap)
        i, rank = entry & PLACE, entry >> 40
        left = symbols[i]
        if left < 0:
            continue  # stale: merged into the symbol before it
        j = after[i]
        if rank_of((left, symbols[j])) != rank:
            continue  # stale: one of the two has been merged meanwhile
        new = symbols[i] = made[rank]
        symbols[j] = -1
        after[i] = k = after[j]
        before[k] = i
        rank = rank_of((new, symbols[k]))
        if rank is not None:
            heappush(heap, (rank << 40) + i)
        h = before[i]
        if h >= 0:
            rank = rank_of((symbols[h], new))
            if rank is not None:
                heappush(heap, (rank << 40) + h)
    return [s for s in symbols if s >= 0]


class Pieces(dict):
    """piece -> its ids, packed as little-endian unsigned 32-bit integers.

    Two generations: this dict is the younger one. When it is full it becomes the older one, whose pieces come back when
    they are met again; those that are not go with it."""

    def __init__(self, spec: dict):
        self.first, self.ranks, self.made, self.older = spec["bytes"], spec["ranks"], spec["made"], {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = merge([self.first[b] for b in piece.encode("utf-8", "surrogatepass")], self.ranks, self.made)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    def __init__(self, text: str):
        self.spec = parse(text)
        self.pieces, self.find = Pieces(self.spec), regex.compile(PATTERN).findall
        added = sorted(self.spec["added"], key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def encode(self, text: str) -> bytes:
        parts = self.added.split(text) if self.added else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(struct.pack("<I", self.spec["added"][part]))
            elif part:
                if self.spec["prefix_space"] and not part[0].isspace():
                    part = f" {part}"
                out.append(b"".join(map(self.pieces.__getitem__, self.find(part))))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.spec["strings"].__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One for each worker process and tokenizer file."""
    text = shared.value
    if (key := hash(text)) not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(text)
    return _CODECS[key]


def _share(spark: SparkSession, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:  # on the driver; a vocabulary file has a few MB
        return spark.sparkContext.broadcast(f.read())


def encode_column(spark: SparkSession, tokenizer: str, text: Column) -> Column:
    shared = _share(spark, tokenizer)

    @F.pandas_udf("binary")
    def encode_text(texts: pd.Series) -> pd.Series:
        encode = _codec(shared).encode
        return pd.Series([encode(t or "") for t in texts], dtype=object)

    return encode_text(F.coalesce(text.cast("string"), F.lit("")))


def decode_column(spark: SparkSession, tokenizer: str, ids: Column) -> Column:
    shared = _share(spark, tokenizer)

    @F.pandas_udf("string")
    def decode_ids(packed: pd.Series) -> pd.Series:
        decode = _codec(shared).decode
        return pd.Series([decode(bytes(p or b"")) for p in packed], dtype=object)

    return decode_ids(F.coalesce(ids, F.lit(b"")))


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the text's ids, packed as little-endian
    unsigned 32-bit integers (4 bytes an id).

    Null text: as the empty text, no ids. An input column called ``ids_col``
    is replaced; all other columns and rows (repeated ones too) stay."""
    prepare(docs.sparkSession)
    return docs.withColumn(ids_col, encode_column(docs.sparkSession, tokenizer, F.col(text_col)))


def decode(docs: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``: the text of packed ids (null ids: empty).
    Bytes that are no UTF-8 become U+FFFD; an id outside the vocabulary fails."""
    prepare(docs.sparkSession)
    return docs.withColumn(text_col, decode_column(docs.sparkSession, tokenizer, F.col(ids_col)))


def round_trip(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with what ``encode`` and then ``decode`` add, in one pass: a task
    has one Python worker, and one vocabulary in memory, instead of two.

    Null and empty texts: no ids, and the empty text. Input columns called
    ``ids_col`` or ``decoded_col`` are replaced; all other columns and rows stay."""
    prepare(docs.sparkSession)
    shared = _share(docs.sparkSession, tokenizer)

    @F.pandas_udf("ids binary, decoded string")
    def both(texts: pd.Series) -> pd.DataFrame:
        codec = _codec(shared)
        ids = [codec.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([codec.decode(i) for i in ids], dtype=object)})

    (made,) = fresh(docs, "bpe_made")
    got = docs.withColumn(made, both(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return got.withColumns({ids_col: F.col(f"{made}.ids"), decoded_col: F.col(f"{made}.decoded")}).drop(made)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = round_trip(docs, tokenizer_path()).select("doc_id", "ids", "decoded")
    return both.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with ``ids``, ``n_tokens`` and ``decoded`` of each text."""
    out = round_trip(docs, tokenizer_path())
    return out.withColumn("n_tokens", F.expr("octet_length(ids) div 4").cast("long"))
