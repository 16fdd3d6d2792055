import hashlib
import random
from collections import Counter, defaultdict

import pytest

from panelscope.llm import align, bpe

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
A, B = bpe.tokenizer_path(), bpe.tokenizer_path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "\n\n  x\t", "<|endoftext|> <s></s><unk>", "I'll we've don't", "日本語テキスト 한국어", "👩‍👩‍👧 emoji", "é̀", "\x00\x1c\x85 ctl", "a▁b", "ﬁ ½ Å",
    "1234567 ١٢٣", "a" * 3000, "#$%^&*()" * 50, "\r\n\t tab", "ǅ ß İ", "word " * 400, " " * 5000 + "x", "the the the the", "　x y", "​﻿ zero",
]


@pytest.fixture(scope="module")
def both():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, both):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, and the counts of pairs."""
    a_tok, b_tok = both
    letters = {c: b for b, c in bpe.byte_letters().items()}
    a_bytes = lambda i: bytes(letters[c] for c in a_tok.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    seen, counts = [], Counter()
    for t in texts:
        a, b = [], []
        if t:
            a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
        x, y = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            seen.append(None)
            continue
        groups, links, i, j, ea, eb, ga, gb = [], [], 0, 0, len(x[0]), len(y[0]), [a[0]], [b[0]]
        while True:
            links.append((a[i], b[j]))
            if ea == eb:
                groups.append((ga, gb))
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                ga, gb, ea, eb = [a[i]], [b[j]], ea + len(x[i]), eb + len(y[j])
            elif ea < eb:
                i += 1
                ga.append(a[i])
                ea += len(x[i])
            else:
                j += 1
                gb.append(b[j])
                eb += len(y[j])
        seen.append((len(a), len(b), groups, links))
        counts.update(links)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for s in seen:
        if s is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in s[2])
            out.append((s[0], s[1], len(s[2]), len(s[3]), sum(counts[p] == top[p[1]] for p in s[3]), sum(counts[p] for p in s[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out, counts


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_equals_a_walk_over_both(spark, both, monkeypatch, size):
    monkeypatch.setattr(align, "CHUNK", size)
    rng = random.Random(1)
    alphabet = "abcthe  \n.,'sé漢字ñ9 0\t"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(120)]
    docs = spark.createDataFrame([(n, t, 1, "q") for n, t in enumerate(texts)] + [(0, "the cat", 1, "q"), (None, "the hat", 1, "q")], "doc_id long, text string, n_a int, chunk string").repartition(3)
    got, pairs = align.align(docs, A, B)
    want, counts = brute([*texts, "the cat", "the hat"], both)
    mine = [(r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in got.collect()]
    assert sorted(map(str, (r[:8] for r in mine))) == sorted(str((i, *w)) for i, w in zip([*range(len(texts)), 0, None], want, strict=True))
    assert all((hashlib.sha256(r[8].encode()).hexdigest() if r[8] else "") == r[7] for r in mine)
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(counts)


def test_chunks_of_a_few_texts(both):
    """The rows of small chunks, without Spark's workers: pairs and documents fit together across them."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        sides = align.Sides(a.read(), b.read())
    schema = to_arrow_schema(T.StructType.fromDDL(align.CHUNKS.format(id="bigint")))
    texts = [t or "" for t in ODD]
    want, counts = brute(texts, both)
    total, n = Counter(), 0
    for start in range(0, len(texts), 5):
        part = texts[start : start + 5]
        docs, last = align.chunk_rows(pa.array(range(start, start + len(part)), pa.int64()), part, 7, sides, True, schema)
        keys = last["key"][0].as_py()
        total.update(dict(zip(keys, last["total"][0].as_py(), strict=True)))
        for r in docs.to_pylist():
            n += 1
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (*want[r["id"]][:4], want[r["id"]][6])
            assert sum(r["times"]) == r["n_links"] and len(set(r["pair"])) == len(r["pair"])
            assert sum(counts[keys[p] >> 32, keys[p] & 0xFFFFFFFF] * t for p, t in zip(r["pair"], r["times"], strict=True)) == want[r["id"]][5]
    assert n == len(texts) and {(k >> 32, k & 0xFFFFFFFF): v for k, v in total.items()} == dict(counts)


def test_faster_encoder_equals_the_library(both):
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        sides = align.Sides(a.read(), b.read())
    texts = [" a" + c + "1" + c + " " + c + c + "'s" + c + "  " + c + "!" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000, 3)])]
    ids = sides.encode(texts)["a"].to_pylist()
    assert ids == [e.ids for e in both[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_query_over_given_documents(spark, both):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute([r.text for r in rows], both)
    got = align.op13_alignment(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, *w) for r, w in zip(rows, want, strict=True))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_empty(spark):
    docs, pairs = align.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert docs.count() == 0 and pairs.count() == 0
    docs, pairs = align.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B)
    assert sorted((r.id, r.n_a, r.count_sum, r.groups_sha256) for r in docs.collect()) == [(1, 0, 0, ""), (2, 0, 0, "")] and pairs.count() == 0
