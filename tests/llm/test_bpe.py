import hashlib
import random

import numpy as np
import pytest

from panelscope.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
ODD = ["", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "I'll we've 'S don't", "  two  spaces ", " 　x y", "日本語テキスト", "👩‍👩‍👧 emoji", "é̀", "\x00\x1c\x85 ctl", "1234567 ١٢٣", "a" * 5000, "#$%^&*()" * 50, "\r\n\t tab", "ǅ ß İ"]


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path())


def check(rows, reference):
    for r in rows:
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(np.frombuffer(bytes(r["ids"]), "<u4")) == ids
        assert r["decoded"] == reference.decode(ids, skip_special_tokens=False)


def test_ids_and_round_trip_on_odd_texts(spark, docs_of, reference):
    rng = random.Random(3)
    alphabet = "abcthe  \n.,'sé漢字ñ9 0\t<|endoftext|>"
    texts = ODD + [None] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(150)]
    docs = docs_of(list(enumerate(texts)) + [(0, ODD[0]), (None, "null id")]).withColumnRenamed("lang", "IDS")
    out = bpe.decode(bpe.encode(docs, bpe.tokenizer_path()), bpe.tokenizer_path()).select("text", "ids", "decoded").collect()
    assert len(out) == len(texts) + 2
    check(out, reference)
    once = bpe.round_trip(docs, bpe.tokenizer_path())
    assert once.columns == bpe.decode(bpe.encode(docs, bpe.tokenizer_path()), bpe.tokenizer_path()).columns
    assert sorted(map(repr, once.select("text", "ids", "decoded").collect())) == sorted(map(repr, out))
    assert once._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_merge_takes_lowest_rank_then_leftmost():
    ranks, made = {(2, 1): 0, (1, 2): 1, (11, 11): 2}, [11, 10, 12]
    assert bpe.merge([1, 2, 1, 2, 1], ranks, made) == [1, 12]
    assert bpe.merge([1, 2], ranks, made) == [10] and bpe.merge([], ranks, made) == [] and bpe.merge([5], ranks, made) == [5]


def test_pieces_keep_two_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        pieces = bpe.Pieces(bpe.parse(f.read()))
    want = {p: pieces[p] for p in ("a", " the", " cat", "xyzzy")}
    assert set(pieces) == {"xyzzy"} and set(pieces.older) == {"a", " the", " cat"}
    merges = []
    monkeypatch.setattr(bpe, "merge", lambda *x: merges.append(x) or [0])
    assert pieces[" the"] == want[" the"] and not merges and " the" in pieces
    pieces["new"], pieces["newer"]
    assert pieces["xyzzy"] == want["xyzzy"] and len(merges) == 2 and pieces["a"] != want["a"]  # gone with its generation


def test_query_over_given_documents(spark, reference):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in bpe.op1_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = reference.encode(r["text"], add_special_tokens=False).ids
        x = got[r["doc_id"]]
        assert x["n_tokens"] == len(ids)
        assert x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark, docs_of):
    assert bpe.decode(bpe.encode(docs_of([]), bpe.tokenizer_path()), bpe.tokenizer_path()).count() == 0
    assert bpe.round_trip(docs_of([]), bpe.tokenizer_path()).count() == 0
