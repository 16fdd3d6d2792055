import random

import numpy as np
from pyspark.sql import functions as F

from panelscope.llm import linededup as ld


def grams(x):
    return {x[i : i + 5] for i in range(len(x) - 4)} if len(x) >= 5 else {x}


def brute(docs):
    """place -> first place of its component, by all pairs."""
    at = [((i is None, i, pos), ln.strip(" \t\r\x0b\x0c").lower()) for i, t in docs for pos, ln in enumerate((t or "").split("\n")) if ln.strip(" \t\r\x0b\x0c")]
    texts = sorted({x for _, x in at})
    sets, root = {x: grams(x) for x in texts}, {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(texts):
        for y in texts[:k]:
            if 5 * min(len(sets[x]), len(sets[y])) < 4 * max(len(sets[x]), len(sets[y])):
                continue  # too unlike in size
            n = len(sets[x] & sets[y])
            if n >= 0.8 * (len(sets[x]) + len(sets[y]) - n):
                root[find(x)] = find(y)
    first = {}
    for p, x in sorted(at, key=lambda q: (q[0][0], q[0][1] or 0, q[0][2])):
        first.setdefault(find(x), p)
    return {p: first[find(x)] for p, x in at}


def made():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)] + ["é1", "漢字"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pool = [line(rng.randrange(1, 40)) for _ in range(150)]
    docs = []
    for i in range(60):
        out = []
        for _ in range(rng.randrange(0, 8)):
            x = rng.choice(pool)
            if rng.random() < 0.5:
                w = x.split(" ")
                w[rng.randrange(len(w))] = rng.choice(words)
                x = " ".join(w)
            out.append(f"  {x.upper() if rng.random() < 0.2 else x}\r")
        docs.append((i, "\n".join(out)))
    return docs + [(60, None), (61, ""), (62, "\n \n"), (63, "x" * 50_000 + "\n" + "x" * 50_000), (64, "ab\nab\nAB "), (None, pool[0] + "\nonly here, at the null id")]


def test_components_equal_brute_force(spark, docs_of, sf):
    docs = made()
    got = {(r.doc_id is None, r.doc_id, r.line_no): (r.component_doc_id is None, r.component_doc_id, r.component_line_no) for r in ld.op5_linededup(spark, sf(documents=docs_of(docs))).collect()}
    want = brute(docs)
    assert got.keys() == want.keys()
    same = sum(got[p] == want[p] for p in want)
    assert same / len(want) >= 0.98
    assert len(set(got.values())) >= len(set(want.values()))  # nothing that isn't similar is joined


def test_texts_after_dedup(spark, docs_of):
    same = "this very line stands in several of the documents, and once more here"
    docs = docs_of([(2, f"{same}\nbeta only line"), (1, f"alpha only line\n\n{same}"), (3, same), (4, None), (5, "\n"), (1, f"alpha only line\n\n{same}"), (None, f"{same}!\nlast of all")])
    docs = docs.withColumnRenamed("lang", "key").withColumnRenamed("source", "pos")
    got = ld.dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 9, r.text or "-") for r in got.collect()) == [(1, f"alpha only line\n\n{same}"), (1, f"alpha only line\n\n{same}"), (2, "beta only line"), (4, "-"), (5, "\n"), (9, "last of all")]
    assert ld.dedup_lines(docs_of([])).count() == 0


def family(n, seed=5):
    """Lines of one template, of 20 words with 3 varying ones, each with a variant of one other letter."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9)))
    template, pool, out = [word() for _ in range(20)], [word() for _ in range(400)], []
    for _ in range(n):
        w = list(template)
        for k in rng.sample(range(20), 3):
            w[k] = rng.choice(pool)
        x = " ".join(w)
        k = rng.randrange(len(x))
        out += [x, x[:k] + ("q" if x[k] != "q" else "z") + x[k + 1 :]]
    return sorted(set(out))


def true_links(lines, least=0.8):
    """Index pairs of the lines whose Jaccard similarity is ``least`` or more, by all pairs."""
    number = {}
    ids = [[number.setdefault(g, len(number)) for g in sorted(grams(x))] for x in lines]
    has = np.zeros((len(lines), len(number)), np.float32)
    for i, at in enumerate(ids):
        has[i, at] = 1
    both, size = has @ has.T, has.sum(1)
    return np.argwhere(np.triu(both >= least * (size[:, None] + size[None, :] - both) - 1e-3, 1))


def recall(spark, docs_of, lines):
    """Of the true links, the share whose lines end in one component; and whether lines of different true components do."""
    comp = {r.id: r.first.id for r in ld.classed(docs_of(list(enumerate(lines)))).collect()}
    links = true_links(lines)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        root[find(i)] = find(j)
    assert all(find(i) == find(c) for i, c in comp.items())  # nothing that isn't similar is joined
    return len(links), sum(comp[i] == comp[j] for i, j in links) / max(1, len(links))


def test_recall_of_true_links_in_a_family_of_thousands(spark, docs_of, monkeypatch):
    """One template, thousands of lines: every bucket is large, and most of its pairs aren't similar."""
    pairs, cross = [], ld.cross
    monkeypatch.setattr(ld, "cross", lambda b: pairs.append(cross(b)) or pairs[-1])
    n, share = recall(spark, docs_of, family(1500))
    assert n >= 1500 and share >= 0.95, (n, share)
    assert len(pairs) > 1  # buckets were divided


def test_no_similar_pair_of_a_large_bucket_is_left_out(spark):
    """One bucket, each line of a component of its own and with another of similarity little above 0.8: all such pairs are compared, and not all pairs."""
    rng, lines = random.Random(8), []
    for _ in range(150):
        x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(144)).strip()
        y = x
        for k in (20, 60, 100):
            y = y[:k] + "#" + y[k + 1 :]
        lines += [x, y]
    texts = spark.createDataFrame(list(enumerate(lines)), "a long, norm string")
    bucket = texts.select(F.lit(1).cast("long").alias("k"), "a", F.col("a").alias("c"))
    pairs = {(r.a, r.b) for r in ld.apart(bucket, texts).collect()}
    links = {(int(i), int(j)) for i, j in true_links(lines)}
    assert len(links) >= 100 and links <= pairs, (len(links), len(links - pairs))
    assert len(pairs) < len(lines) * (len(lines) - 1) // 4


def test_pairs_of_a_large_bucket_that_cannot_be_similar_are_not_made(spark):
    """Lines of one template, each a component of its own: all similar pairs are made, and few others."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9)))
    template, pool, lines = [word() for _ in range(20)], [word() for _ in range(30)], set()
    for _ in range(300):
        w = list(template)
        for k in rng.sample(range(20), 7):
            w[k] = rng.choice(pool)
        x = " ".join(w)
        lines |= {x, x[:9] + "#" + x[10:]}
    lines = sorted(lines)
    texts = spark.createDataFrame(list(enumerate(lines)), "a long, norm string")
    bucket = texts.select(F.lit(1).cast("long").alias("k"), "a", F.col("a").alias("c"))
    pairs = {(r.a, r.b) for r in ld.apart(bucket, texts).collect()}
    links = {(int(i), int(j)) for i, j in true_links(lines)}
    assert len(links) >= 250 and links <= pairs, (len(links), len(links - pairs))
    assert len(pairs) <= 2 * len(links), (len(pairs), len(links))


def test_lines_of_one_family_are_not_compared_pair_by_pair(spark, docs_of, monkeypatch):
    """Near copies of one line, about half of the pairs similar: most are joined through a few of them, so few pairs are compared, and no link is lost."""
    rng, lines, compared, verified = random.Random(21), set(), [], ld.verified
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    template, pool = [word() for _ in range(70)], [word() for _ in range(300)]
    for _ in range(500):
        w = list(template)
        for k in rng.sample(range(70), rng.randrange(2, 9)):
            w[k] = rng.choice(pool)
        lines.add(" ".join(w))
    monkeypatch.setattr(ld, "verified", lambda pairs, *x: compared.append(pairs.count()) or verified(pairs, *x))
    n, share = recall(spark, docs_of, sorted(lines))
    assert n >= 5_000 and share >= 0.99, (n, share)
    assert max(compared) <= 16 * len(lines), compared


def test_recall_of_true_links_among_lines_that_share_a_passage(spark, docs_of):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    passage, lines = " ".join(word() for _ in range(50)), []
    for _ in range(500):
        x = " ".join(word() for _ in range(rng.randrange(10, 40))) + " " + passage
        k = rng.randrange(len(x))
        lines += [x, x[:k] + "#" + x[k + 1 :]]
    n, share = recall(spark, docs_of, sorted(set(lines)))
    assert n >= 500 and share >= 0.95, (n, share)


def test_recall_of_true_links_on_given_lines_and_short_ones(spark, docs_of):
    text = [t for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    given = sorted({x for t in text for y in (t or "").split("\n") if (x := y.strip(" \t\r\x0b\x0c").lower())})
    rng = random.Random(9)
    short = [x for x in given if 20 <= len(x) <= 90][:300]
    edits = [x[:k] + "#" + x[k + 1 :] for x in short for k in [rng.randrange(len(x))]]
    n, share = recall(spark, docs_of, sorted(set(given + edits)))
    assert n > 200 and share >= 0.95, (n, share)


def test_lines_whose_first_hash_is_equal(spark, docs_of, monkeypatch):
    docs = docs_of([(i, f"line number {i % 40} of {chr(97 + i % 40 % 26) * 30} and no other") for i in range(80)])
    want = sorted((r.id, r.first.id) for r in ld.classed(docs).collect())
    real = F.xxhash64
    # all but 3 bits of the first hash of a line are lost
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(8)) if len(c) == 1 and isinstance(c[0], str) and c[0] == "norm" else real(*c))
    assert sorted((r.id, r.first.id) for r in ld.classed(docs).collect()) == want


def test_short_lines_and_long_tokens_share_a_band(spark, docs_of):
    """Pairs of lines of 6 to 12 words or of one token, with one other letter, that are similar: nearly all share a band."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    kinds = {f"{n} words": [" ".join(word(rng.randrange(4, 9)) for _ in range(n)) for _ in range(400)] for n in (6, 8, 12)}
    kinds["token"] = [word(60) for _ in range(400)]
    pairs = []
    for kind, xs in kinds.items():
        for x in xs:
            k = rng.randrange(8) if kind == "token" else rng.choice([i for i, c in enumerate(x) if c != " "])
            y = x[:k] + ("q" if x[k] != "q" else "z") + x[k + 1 :]
            both = len(grams(x) & grams(y))
            if both >= 0.8 * (len(grams(x)) + len(grams(y)) - both):
                pairs.append((kind, x, y))
    lines = sorted({x for _, *xy in pairs for x in xy})
    at = docs_of(list(enumerate(lines))).select(F.xxhash64("text").alias("a"), F.col("text").alias("norm"))
    bands = {}
    for r in ld.signatures(at).join(at, "a").collect():
        bands.setdefault(r.norm, set()).update(r.bands)
    for kind in kinds:
        mine = [bool(bands[x] & bands[y]) for k, x, y in pairs if k == kind]
        assert len(mine) >= 50 and sum(mine) / len(mine) >= 0.97, (kind, sum(mine), len(mine))
