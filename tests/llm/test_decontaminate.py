import hashlib
import random
import re

import duckdb
import pytest

from panelscope.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    grams = {}
    for item, t in bench:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for i, t in docs:
        w = words(t)
        hit, items = set(), set()
        for g, ids in grams.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    items |= ids
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made():
    rng = random.Random(2)
    vocab = ["The", "a", "of", "É", "éa", "Ωm", "x1", "漢字", "naïve"] + [f"v{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, say(rng.randrange(8, 30))) for i in range(12)] + [(12, None), (13, "..."), (14, "Rare short"), (14, "rare SHORT"), (15, "a a a a a a a a a a a a"), (16, bench_copy := say(15)), (17, bench_copy)]
    docs = [(i, say(rng.randrange(0, 60))) for i in range(40)]
    for i in range(40, 80):
        w = rng.choice(bench)[1] or ""
        k = rng.randrange(0, 4)
        docs.append((i, say(rng.randrange(0, 12)) + ", " + "--".join(w.upper().split(" ")[k:]) + "\n" + say(5)))
    docs += [(80, None), (81, ""), (82, "a " * 5000), (83, "so rare, SHORT!"), (83, "so rare, SHORT!"), (None, "rare short")]
    return docs, bench


@pytest.mark.parametrize("block", [dc.BLOCK, 40])
def test_hits_equal_brute_force(spark, docs_of, block, monkeypatch, sf):
    docs, bench = made()
    monkeypatch.setattr(dc.hits, "__defaults__", tuple(block if d == dc.BLOCK else d for d in dc.hits.__defaults__))
    d = sf(documents=docs_of(docs), benchmark=spark.createDataFrame(bench, "item_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.op3_decontaminate(spark, d).collect()]
    assert sorted(got, key=str) == brute(docs, bench)


def test_sql_equals_query_on_given_tables(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = sorted(con.execute(dc.SQL).fetchall())
    assert sorted(tuple(r) for r in dc.op3_decontaminate(spark, d).collect()) == want
    assert any(r[-1] for r in want)


def test_modes(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [(1, "Start, one two three four five six seven eight nine TEN; end."), (2, "clean one two"), (3, None), (4, ""), (2, "clean one two")]
    docs = docs_of(rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "items")
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3, 4]
    spans = dc.decontaminate(docs, bench, mode="span")
    assert spans.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in spans.collect() if r.doc_id != 3) == [(1, "Start, end."), (2, "clean one two"), (2, "clean one two"), (4, "")]
    assert dc.decontaminate(docs, bench.where("false")).count() == 5
    assert dc.decontaminate(docs_of([]), bench, mode="span").count() == 0
