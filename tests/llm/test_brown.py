import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelscope.llm import brown


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def brute(docs):
    train = Counter(x for i, t in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 10 for x in toks(t))
    n, v = sum(train.values()), len(train)
    return [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(toks(t)), sum(train[x] > 0 for x in toks(t)), n, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks(t))) for i, t in docs]


def made():
    rng = random.Random(6)
    a, b = [f"a{i}x" for i in range(60)], [f"é{i}Ü" for i in range(60)]
    docs = []
    for i in range(300):
        w = rng.choice([a, b])
        docs.append((i, " ".join(rng.choice(w) if rng.random() < 0.9 else f"Rare{rng.randrange(2000)}{w[0][0]}" for _ in range(rng.randrange(1, 60)))))
    return docs + [(300, None), (301, ""), (302, " \n"), (303, "word " * 5000), (7, docs[7][1]), (7, "other text of the same id"), (None, "a null id"), (310, "never seen before"), (320, "<|end|> \x1c a\x85b")]


@pytest.mark.parametrize("cache", [brown.CACHE, 20])
def test_base_score_equals_brute_force_and_model_beats_it(spark, docs_of, sf, cache, monkeypatch):
    docs = made()
    monkeypatch.setattr(brown.learn, "__defaults__", (cache, min(cache, 100), 8, 6))
    got = brown.op7_brown(spark, sf(documents=docs_of(docs))).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    want = sorted(brute(docs), key=key)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert np.allclose([w[5] for w in want], [h[5] for h in have], rtol=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(0)
    kind = np.r_[0, np.arange(40) % 2 + 1]
    pairs = np.zeros((41, 41))
    for i in range(1, 41):
        for j in range(1, 41):
            pairs[i, j] = rng.poisson(30 if kind[i] != kind[j] else 1)
    of = brown.exchange(pairs, 3)
    assert len(set(zip(kind, of))) == 3


def test_probabilities_sum_to_one(spark, docs_of):
    model, counts = brown.learn(docs_of([(i, "x y z zz abc " * (i + 1)) for i in range(5)]), items=2, endings=2, classes=3)
    rows = {bytes(r.word): r.c for r in counts.collect()}
    n = model.numbering
    for c in range(model.classes):
        p = 0.0
        for i in range(n.size):
            if i < model.first:
                p += 10 ** model.step[c, i]
            else:
                of = [w for w in rows if n.of(w) == i and w not in n.words]
                p += sum(10 ** model.step[c, i] * (rows[w] + 0.1) for w in of) + 0.1 * 10 ** model.step[c, i]
        assert abs(p - 1) < 1e-9


def test_empty(spark, docs_of, sf):
    assert brown.op7_brown(spark, sf(documents=docs_of([]))).count() == 0


def test_every_word_has_a_class_by_its_neighbours(spark, docs_of):
    """Words outside the cache, all of one ending, in two kinds of place where cached words stand too: they get two classes, and the score is the model's, by brute force."""
    rng = random.Random(2)
    rare = {f"{p}{i}qqq": p for i in range(40) for p in "uv"}
    docs = []
    for i in range(400):
        w = rng.choice(list(rare))
        u, v = rng.choice(["cat", "dog", w]), rng.choice(["see", "hit", w])
        docs.append((i, f"the {u} runs" if rare[w] == "u" else f"we {v} it") if i % 9 else (i, f"z{i % 7}qqz z{i % 5}qqz"))
    docs += [(400 + i, f"the {w} runs" if p == "u" else f"we {w} it") for i, (w, p) in enumerate(3 * list(rare.items()))]
    model, words = brown.learn(docs_of(docs), cache=8, items=8, endings=3, classes=13)
    rows = {bytes(r.word): r for r in words.collect()}
    assert {w: r.c for w, r in rows.items()} == dict(Counter(x.encode() for _, t in docs for x in toks(t)))
    kinds = Counter((p, rows[w.encode()]["class"]) for w, p in rare.items())
    (_, a), n = Counter({x: m for x, m in kinds.items() if x[0] == "u"}).most_common(1)[0]
    (_, b), m = Counter({x: m for x, m in kinds.items() if x[0] == "v"}).most_common(1)[0]
    assert a != b and n >= 36 and m >= 36, kinds
    # probabilities over all words and the endings of words never seen
    of = lambda w: rows[w]["class"] if w in rows else int(model.of[model.numbering.of(w)])
    by = np.zeros((model.classes, model.classes))
    for _, t in docs:
        c = [0, *(of(x.encode()) for x in toks(t))]
        np.add.at(by, (c[:-1], c[1:]), 1)
    move = (by + 0.1) / (by.sum(1, keepdims=True) + 0.1 * model.classes)
    size = np.bincount([r["class"] for r in rows.values()], minlength=model.classes) + np.bincount(model.of[model.first :], minlength=model.classes)
    mass = by.sum(0) + 0.1 * size
    assert np.allclose(10**model.move, move)
    more = [(1000, "the never u1qqq seenqqq we"), (1001, None), (1002, "v3qqq v4qqq v3qqq"), (1003, "the")]
    for r in brown.score(docs_of(docs[:30] + more), model, words).collect():
        t = [x.encode() for x in toks(dict(docs + more)[r.doc_id])]
        p = sum(math.log10(move[of(x), of(y)] * ((rows[y].c if y in rows else 0) + 0.1) / mass[of(y)]) for x, y in zip([b"\n", *t], t))
        assert abs(r.score - p) < 1e-9, (r, p)


def test_pairs_of_cached_words_are_gathered_not_shuffled(spark, docs_of):
    """Pair counts are rows of lists, at most one for an item and task, in a plan without an exchange; their sums are those of all pairs."""
    rng = random.Random(31)
    docs = docs_of([(i, " ".join(f"w{rng.randrange(60)}" for _ in range(50))) for i in range(80)]).repartition(2).localCheckpoint()
    numbering = brown.Numbering([f"w{i}".encode() for i in range(60)], [])
    got = brown.pair_counts(docs, numbering)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) <= 2 * numbering.size
    want = Counter()
    for (t,) in docs.select("text").collect():
        ids = [0, *(numbering.of(x.encode()) for x in toks(t))]
        want.update(zip(ids, ids[1:]))
    have = Counter()
    for r in rows:
        for j, n in zip(r["at"], r["n"], strict=True):
            have[r["i"], j] += n
    assert have == want and len(want) > 2000
    of = np.arange(numbering.size) % 5
    by = np.zeros((5, 5))
    for (i, j), n in want.items():
        by[of[i], of[j]] += n
    assert (brown.pairs_by_class(got, of, 5) == by).all()


def test_words_of_a_batch_are_numbered_as_each_word():
    """Texts are split, and words numbered, a batch at a time, with the results of one word at a time."""
    texts = ["", " ", "\n", " A  b\x0b\nÉc\x85d \x1c", "don't STOP", "x" * 5000, "\tz yz xyz wxyz éyz éé é\r"]
    words, sizes = brown.words_of(pa.array(texts))
    want = [toks(t)[:-1] for t in texts]
    assert [w.decode() for w in words.to_pylist()] == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    endings = [brown.ending(w.encode()) for w in ("yz", "wxyz", "éyz", "é")]
    for numbering in (brown.Numbering([b"b", "éé".encode()], endings), brown.Numbering([b"b"], []), brown.Numbering([], endings[:1])):
        assert numbering.of_all(words).tolist() == [numbering.of(w) for w in words.to_pylist()]
        assert numbering.of_all(words[:0]).tolist() == []
    assert brown.with_ends(np.array([5, 6, 7]), np.array([0, 2, 0, 1])).tolist() == [0, 5, 6, 0, 0, 7, 0]


def test_packed_numbers_are_read_back():
    x = brown.packed(np.array([2, 0, 3]), np.arange(5))
    for part, sizes, values in ((x, [2, 0, 3], [0, 1, 2, 3, 4]), (x[1:], [0, 3], [2, 3, 4]), (x[1:2], [0], []), (x[:0], [], [])):
        n, got = brown.unpacked(part, np.int64)
        assert n.tolist() == sizes and got.tolist() == values
    n, got = brown.unpacked(brown.packed(np.zeros(2, np.int64), np.empty(0, np.int32)), np.int32)
    assert n.tolist() == [0, 0] and not got.size


def test_rows_of_a_word_are_placed_by_one_sort(spark):
    """A word's rows reach its class by one exchange and a sort, without lists collected in the JVM, also where they go on over several Arrow batches."""
    rng = random.Random(4)
    by = np.array([[rng.randrange(1, 90) for _ in range(4)] for _ in range(4)], float)
    rows, want = [], {}
    for _ in range(300):
        w = f"w{rng.randrange(40)}".encode()
        x, y, z = ([rng.randrange(1, 5) * 8 + rng.randrange(8) for _ in range(rng.randrange(n))] for n in (4, 3, 2))
        rows.append((w, *(np.array(v, np.int64).tobytes() for v in (x, y)), z[0] if z else 0))
        has = want.setdefault(w, np.zeros((2, 8)))
        for i, v in ((0, x), (1, y + z)):
            for m in v:
                has[i, m % 8] += m // 8
    near = spark.createDataFrame(rows, "word binary, x binary, y binary, z long").repartition(3)
    got = brown.place(near, by, "binary")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "collect_list" not in plan
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = got.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(bytes(r.word) for r in found) == sorted(want)
    move, share = brown.logs(by), -np.log10(by.sum(0) + 0.1)
    share[0] = -np.inf
    for r in found:
        own, has = want[bytes(r.word)][0], want[bytes(r.word)].sum(0)
        assert r.c == has[:4].sum()
        scores = has @ np.vstack([move.T, move]) + max(r.c, 1) * share
        assert scores[r["class"]] >= scores.max() - 1e-9
        x = np.frombuffer(bytes(r.x), np.int64)
        assert (np.bincount(x % 8, x // 8, 8) == own).all()
