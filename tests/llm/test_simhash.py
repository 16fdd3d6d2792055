import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from panelscope.llm import simhash
from panelscope.llm.components import components


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(items, 2):
        if linked(x, y):
            a, b = sorted((find(x), find(y)))
            root[b] = a
    return {i: find(i) for i in items}


def check(docs, got):
    fp = {i: brute_fp(t) for i, t in docs}
    comp = brute_components(sorted(fp), lambda x, y: (fp[x] ^ fp[y]).bit_count() <= 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


def test_query_equals_brute_force(spark, docs_of, sf):
    rng = random.Random(5)
    words = ["Alpha", "béta", "ÉTÉ", "x", "gamma\x0b", "delta", " em", "Ω"] + [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))) for i in range(120)]
    for i in range(120, 260):  # near copies, chains of them
        t = rng.choice(docs)[1].split(" ")
        t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, " ".join(t)))
    docs += [(260, None), (261, ""), (262, " \t\n"), (263, "one two"), (264, "ONE  two"), (265, "word " * 40_000)]
    check(docs, simhash.op9_simhash(spark, sf(documents=docs_of(docs))).collect())


def test_links_find_all_within_distance_and_only_those(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    pts = set(base.tolist())
    for x in base:
        for _ in range(6):
            bits = rng.choice(64, rng.integers(1, 9), replace=False)
            pts.add(int(x) ^ int(np.array(sum(1 << int(b) for b in bits), np.uint64).astype(np.int64)))
    pts = sorted(pts)
    want = brute_components(pts, lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count() <= 4)
    df = spark.createDataFrame([(p,) for p in pts], "fp long")
    for part in (2048, 3):  # 3: all groups with more members are dealt in parts
        e = simhash.links(df, part=part).collect()
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in e)
        linked = {(r.a, r.b) for r in e} | {(r.b, r.a) for r in e}
        assert brute_components(pts, lambda x, y: (x, y) in linked) == want


def test_keep_one(spark, docs_of):
    text = "a long enough text " * 20
    docs = docs_of([(5, text), (3, text), (3, text), (None, text), (9, "something else entirely, by itself"), (9, "another thing that shares its id"), (None, "only null id here and no copies")])
    docs = docs.withColumnRenamed("lang", "fp").withColumnRenamed("source", "component")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"][:6]) for r in kept.collect()) == [(-1, "only n"), (3, "a long"), (9, "anothe"), (9, "someth")]
    assert simhash.keep_one(docs_of([])).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(shape)
    pairs = {"chain": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(100)], "none": []}[shape]
    pairs += [(None, 4)] if shape == "random" else []
    real = {tuple(sorted(p)) for p in pairs if None not in p and p[0] != p[1]}
    nodes = sorted({x for p in real for x in p})
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == brute_components(nodes, lambda x, y: (x, y) in real)
