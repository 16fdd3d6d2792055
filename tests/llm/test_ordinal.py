import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.llm import ordinal


def test_gradient_equals_difference_quotient():
    theta = np.array([-1.0, 0.5, 1.2])

    def loss(z, th, g):
        c = np.r_[0.0, ordinal.sigmoid(th - z), 1.0]
        return -np.log(c[g + 1] - c[g])

    for z in (-2.0, 0.1, 3.0):
        for g in range(4):
            dz, dt = ordinal.gradient(z, theta, g)
            e = 1e-6
            assert abs((loss(z + e, theta, g) - loss(z - e, theta, g)) / (2 * e) - dz) < 1e-4
            for k in range(3):
                up, down = theta.copy(), theta.copy()
                up[k] += e
                down[k] -= e
                assert abs((loss(z, up, g) - loss(z, down, g)) / (2 * e) - dt[k]) < 1e-4


@pytest.fixture(scope="module")
def got(spark):
    d = "/root/testdata/sf0.01"
    return ordinal.op10_ordinal(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").collect()


def test_held_out_accuracy_on_given_tables(got):
    held = [r for r in got if r.held_out and r.quality is not None]
    assert len(got) == 1000 and sum(r.kept == bool(r.quality) for r in held) / len(held) > 0.93
    good = [r for r in held if r.quality]
    assert sum(r.kept for r in good) / len(good) > 0.97
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got)


def test_odd_rows(spark, docs_of):
    docs = docs_of([(1, "x"), (2, None), (3, ""), (1, "x"), (None, "w " * 60_000)]).withColumnRenamed("lang", "Expected_Grade").withColumnRenamed("source", "text_")
    model = ordinal.learn(docs.withColumn("grade", F.lit(None).cast("int")), 3)
    out = ordinal.score(docs, model)
    assert out.columns == ["doc_id", "text", "text_", "n_chars", "expected_grade", "tail_probability"] and out.count() == 5
    rows = [r.asDict() for r in out.collect()]
    assert rows[0]["tail_probability"] == pytest.approx(2 / 3) and sum(r["doc_id"] == 1 for r in rows) == 2
    assert ordinal.score(docs_of([]), model).count() == 0
