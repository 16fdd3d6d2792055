import random

import duckdb
import numpy as np
import pytest

from panelscope.llm import hardneg as hn


def brute(rows, every=10, k=5, n=5):
    """(anchor, positive, rank, negative, scores) by scoring all pairs; rows: (id, label, x)."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    first = lambda c: sorted(c, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    out = []
    for i, (anchor, label, x) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scores = [(r[0], dot(x, r[2]), r[1] == label) for j, r in enumerate(rows) if j != i]
        for p in first([s for s in scores if s[2]])[:k]:
            near = first([s for s in scores if not s[2] and 80 * p[1] <= 100 * s[1] <= 100 * p[1]])[:n]
            out += [(anchor, p[0], rank, s[0], p[1], s[1]) for rank, s in enumerate(near, 1)]
    return sorted(map(str, out))


def mined(spark, rows, **kw):
    v = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, label int, x array<bigint>, row int, Score string")
    return sorted(str(tuple(r)) for r in hn.mine(v.repartition(3), "id % 10 = 0", **kw).collect())


def random_rows(n, dim, seed, spread=40, labels=3):
    rng = random.Random(seed)
    mid = [[rng.randrange(-spread, spread) for _ in range(dim)] for _ in range(5)]
    return [(i, rng.randrange(labels), [m + rng.randrange(-9, 9) for m in rng.choice(mid)]) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 2, 7, 33])
def test_equals_all_pairs(spark, dim):
    rows = random_rows(300, dim, dim)
    assert mined(spark, rows) == brute(rows)


def test_odd_rows_and_ties(spark):
    rows = random_rows(120, 6, 4)
    rows += [(10, 1, rows[10][2]), (10, 1, rows[10][2]), (20, None, [1] * 6), (30, 2, None), (40, 1, [None, 1]), (None, 1, [5] * 6), (None, 2, [5] * 6), (50, 7, [9] * 6), (60, 0, []), (-70, 1, [3] * 9)]
    rows += [(1000 + i, i % 2, [1, 2, 3, 4, 5, 6]) for i in range(60)]  # one vector, many rows
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_a_double(spark):
    rows = [(i, i % 2, [2**29 + i, -(2**28) + 3 * i, 1]) for i in range(40)]
    assert mined(spark, rows) == brute(rows)


def test_small_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(hn, "CELLS", 300)
    rows = random_rows(200, 8, 9)
    assert mined(spark, rows) == brute(rows)


def test_bounds_hold_and_coarse_levels_prune():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (6, 4)).repeat(16, axis=1)
    x = centres[rng.integers(0, 6, 400)] + rng.integers(-4, 5, (400, 64))
    mean, dev = hn.summaries(x.astype(float))
    done = 0
    for at in hn.cuts(64):
        p = slice(done, done + len(at))
        mid, off = mean[:, p] @ mean[:, p].T, dev[:, p] @ dev[:, p].T
        assert (np.abs(x @ x.T - mid) <= off + 1e-3).all()
        done += len(at)
    s = {"dim": 64, "mean": mean.astype("f"), "dev": dev.astype("f"), "norm": np.linalg.norm(x, axis=1).astype("f")}
    best = np.sort(x @ x.T, axis=1)[:, -5]
    i, j = hn.bounded(s, s, np.ones((400, 400), bool), best, np.full(400, hn.MOST))
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    assert kept >= set(zip(*map(np.ndarray.tolist, np.nonzero((x @ x.T >= best)))))
    assert len(kept) < 0.25 * 400 * 400


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    got = hn.op11_hard_negatives(spark, d)
    want = con.execute(hn.SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_empty_and_no_anchor(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1]), (2, 2, [1])]) == []


def test_query_on_odd_embeddings(spark, sf):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(250)]
    odd = [(300, [float("nan")] * 4, 1), (400, [float("inf"), 0.0, 0.0, 0.0], 1), (500, [None, 0.5, 0.5, 0.5], 1), (600, None, 1), (700, [0.5] * 4, None), (800, [0.9] * 4, 9), (801, [0.9] * 4, 0), (None, [0.4] * 4, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    d = sf(embeddings=table)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet/*.parquet'")
    got = sorted(map(str, map(tuple, hn.op11_hard_negatives(spark, d).collect())))
    assert got == sorted(map(str, con.execute(hn.SQL).fetchall())) and got
