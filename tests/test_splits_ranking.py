import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelscope.operators.ranking import range_rank
from panelscope.operators.splits import batches, peek, shuffle, split_80_20, split_conserves_rows, split_counts, split_exact, split_tail


def _ids(spark, n, dup=()):
    keys = [f"cell{i:04d}.png" for i in range(n)] + list(dup)
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "LABEL_SAMPLE_ID string, v int")


def _ranks_like_window(got, df, *keys):
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy(*keys)))
    return got.count() == df.count() and got.join(ref.select("id", "rn"), "id").where("r != rn").count() == 0


@pytest.mark.parametrize("nb", [1, 4, 64])
def test_range_rank_equals_row_number(spark, nb):
    random.seed(nb)
    rows = [(random.choice([None, 1, 2, 3, 5, 8]) if i % 3 == 0 else random.randint(0, 10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "x long, id long").repartition(7)
    got = range_rank(df, ["x", "id"], "r", nb, "n")
    assert _ranks_like_window(got, df, "x", "id")
    assert got.agg(F.max("n")).first()[0] == 3000 and got.columns == ["x", "id", "r", "n"]


def _parts(monkeypatch):
    """Rows of each partition that the next rankings write."""
    from panelscope.operators import ranking

    seen, numbered = [], ranking.numbered

    def spy(parts, *a, **k):
        seen.append([r["count"] for r in parts.groupBy(F.shiftright(ranking._POS, ranking.PLACE_BITS)).count().collect()])
        return numbered(parts, *a, **k)

    monkeypatch.setattr(ranking, "numbered", spy)
    return seen


@pytest.mark.parametrize("kind", ["one number", "long start", "null keys", "beyond doubles", "equal rows"])
def test_no_partition_over_twice_the_mean(spark, monkeypatch, kind):
    seen, n = _parts(monkeypatch), 24_000
    ids = F.format_string("img2023_%09d.png", "id")
    num = {
        "one number": F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")), "long start": F.lit(7), "null keys": F.when(F.col("id") % 3 > 0, F.col("id")),
        "beyond doubles": F.lit(1 << 53) + F.col("id") % 4, "equal rows": F.lit(1),
    }[kind]
    df = spark.range(n).select(num.cast("long").alias("num"), (F.lit("same") if kind == "equal rows" else ids).alias("id"))
    got = range_rank(df.repartition(8), ["num", "id"], "r", 16, least_heavy=500)
    if kind == "equal rows":
        assert got.agg(F.min("r"), F.max("r"), F.count_distinct("r")).first() == (1, n, n)
    else:
        assert _ranks_like_window(got, df, "num", "id")
    assert len(seen[0]) == 16 and max(seen[0]) < 2 * n / 16


def test_range_rank_of_few_rows_in_many_partitions(spark, monkeypatch):
    from panelscope.operators import ranking

    jobs = []
    run = ranking.written
    monkeypatch.setattr(ranking, "written", lambda df, what: jobs.append(what) or run(df, what))
    few = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "d"), (2, "e")], "num long, id string")
    for nb in (2, 2000):
        assert _ranks_like_window(range_rank(few, ["num", "id"], "r", nb), few, "num", "id")
    assert jobs == ["ranked"] * 2  # one table each, whatever the number of partitions
    assert range_rank(few.limit(0), [F.col("num") + 1, "id"], "r", 8).count() == 0


def test_split_exact_sizes_and_determinism(spark):
    df = _ids(spark, 620)
    s = split_exact(df, 0.65, seed=1)
    c = split_counts(s, df).first()
    assert (c["n_train"], c["n_test"], c["conserved"]) == (403, 217, True)
    again = split_exact(df.repartition(5), 0.65, seed=1)
    a = {r[0] for r in s.where("split='train'").select("LABEL_SAMPLE_ID").collect()}
    b = {r[0] for r in again.where("split='train'").select("LABEL_SAMPLE_ID").collect()}
    assert a == b
    other = {r[0] for r in split_exact(df, 0.65, seed=2).where("split='train'").select("LABEL_SAMPLE_ID").collect()}
    assert other != a


def test_split_drops_duplicate_ids_from_test(spark):
    df = _ids(spark, 50, dup=["cell0003.png", "cell0003.png"])
    s = split_exact(df, 0.5, seed=0)
    test_ids = [r[0] for r in s.where("split='test'").select("LABEL_SAMPLE_ID").collect()]
    assert "cell0003.png" not in test_ids
    n_train = s.where("split='train'").count()
    assert n_train == 26
    lost = 52 - n_train - len(test_ids)
    if lost:
        with pytest.raises(RuntimeError):
            split_conserves_rows(s, df)
    with pytest.raises(RuntimeError):
        split_conserves_rows(s.where("split='train'"), df)


def test_split_80_20_and_tail_and_batches(spark):
    df = _ids(spark, 101)
    c = split_counts(split_80_20(df), df).first()
    assert c["n_test"] == math.ceil(0.2 * 101) and c["n_train"] == 101 - math.ceil(0.2 * 101)
    t = split_tail(df, ["v"], 0.3)
    val = sorted(r[0] for r in t.where("split='validation'").select("v").collect())
    assert val == list(range(int(101 * 0.7), 101))
    b = batches(df, ["v"], 32)
    assert {r["v"]: r["batch_id"] for r in b.collect()}[64] == 2


def test_shuffle_is_permutation_and_peek(spark):
    df = _ids(spark, 200)
    s = shuffle(df, seed=3)
    assert sorted(r[0] for r in s.select("shuffle_pos").collect()) == list(range(1, 201))
    first = s.orderBy("shuffle_pos").limit(10).select("LABEL_SAMPLE_ID").collect()
    assert [r[0] for r in peek(df, seed=3).collect()] == [r[0] for r in first]


def test_split_exact_with_identical_rows_is_exact(spark):
    rows = [(f"k{i:02d}", i) for i in range(10)] + [("zz", 1)] * 5
    df = spark.createDataFrame(rows, "LABEL_SAMPLE_ID string, v int")
    for seed in range(6):
        s = split_exact(df, 0.5, seed=seed)
        assert s.where("split = 'train'").count() == 8  # round(7.5) half-even
        assert s.where("split = 'test' AND LABEL_SAMPLE_ID = 'zz'").count() == 0


def test_split_exact_hot_id_is_exact(spark):
    # one id holds a third of the rows
    rows = [("hot.png", i) for i in range(3000)] + [(f"c{i:05d}.png", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "LABEL_SAMPLE_ID string, v int").repartition(8)
    for frac in (0.1, 0.5, 0.65, 0.9):
        s = split_exact(df, frac, seed=0)
        assert s.where("split = 'train'").count() == round(frac * 9000)
        assert s.where("split = 'test' AND LABEL_SAMPLE_ID = 'hot.png'").count() == 0
        kept = split_exact(df, frac, seed=0, drop_repeated=False)
        assert {r["split"]: r["count"] for r in kept.groupBy("split").count().collect()} == {"train": round(frac * 9000), "test": 9000 - round(frac * 9000)}


@pytest.mark.parametrize("n", [1, 100, 7001])
def test_split_keeps_equal_rows(spark, n):
    df = spark.createDataFrame([("same.png", 1)] * n, "LABEL_SAMPLE_ID string, v int").repartition(5)
    s = split_80_20(df)
    c = split_counts(s, df).first()
    assert (c["n_test"], c["conserved"]) == (math.ceil(n * 0.2), True) and s.columns == ["LABEL_SAMPLE_ID", "v", "split"]


def test_split_with_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, i) for i in range(40)] + [(f"k{i}", i) for i in range(60)], "LABEL_SAMPLE_ID string, v int")
    c = split_counts(split_80_20(df), df).first()
    assert (c["n_train"], c["n_test"]) == (80, 20)
    s = split_exact(df, 0.2, seed=1)
    assert s.where("split = 'train'").count() == 20 and s.where("split = 'test' AND LABEL_SAMPLE_ID IS NULL").count() == 0
    for frac in (0.0, 1.0):
        assert split_exact(df.limit(0), frac).count() == 0
        assert split_exact(df, frac, drop_repeated=False).where("split = 'train'").count() == 100 * frac


def test_split_draws_the_first_by_hash_key_and_row(spark):
    """A few hash values only, so that every cut lies within one of them."""
    from panelscope.operators import splits

    rows = [(f"k{i % 3}", i % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "LABEL_SAMPLE_ID string, v long")
    ranked = df.withColumn("h", splits.hash_order_key(5, "LABEL_SAMPLE_ID")).withColumn("t", splits._row_hash(df, 5)).orderBy("h", "LABEL_SAMPLE_ID", "t").collect()
    for frac in (0.03, 0.33, 0.5, 0.77):
        got = split_exact(df, frac, seed=5, drop_repeated=False).where("split = 'train'")
        assert sorted(tuple(r)[:2] for r in got.collect()) == sorted(tuple(r)[:2] for r in ranked[: round(200 * frac)])


def test_split_tail_hot_date(spark):
    rows = [(1, i) for i in range(3000)] + [(2 + i % 50, 10**6 + i) for i in range(6000)]
    df = spark.createDataFrame(rows, "d long, k long")
    t = split_tail(df, ["d", "k"], 0.3)
    val = {r["k"] for r in t.where("split = 'validation'").collect()}
    ordered = sorted(rows)
    assert val == {k for _, k in ordered[int(9000 * 0.7):]}


def test_split_80_20_keeps_repeated_keys(spark):
    from panelscope.operators.splits import split_80_20

    df = spark.range(1000).selectExpr("cast(id % 100 as string) as LABEL_SAMPLE_ID", "id as v")
    got = {r["split"]: r["count"] for r in split_80_20(df).groupBy("split").count().collect()}
    assert got == {"train": 800, "test": 200}
