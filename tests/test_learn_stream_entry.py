import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators import aggregates as agg
from panelscope.operators.learn import batch_infer, centroid_predict_fn, class_centroids, score_summary
from panelscope.sources.tables import image_samples, label_frame
from tests.conftest import SF001, SF01


def test_linear_fit_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = 3.0 * x + 2.0 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    f = agg.linear_fit(df, "x", "y").first()
    m, b = np.polyfit(x, y, 1)
    assert abs(f["slope"] - m) < 1e-9 and abs(f["intercept"] - b) < 1e-9 and f["n"] == 200
    hist = {r["bin"]: r["n"] for r in agg.residual_hist(df.withColumn("r", F.col("y") - 3 * F.col("x") - 2), "r", -1, 1, 4).collect()}
    assert sum(hist.values()) == 200


def test_guards(spark):
    lbl = label_frame(spark, SF01)
    agg.distinct_count_guard(lbl, "PROBABILITY", ("a", "b", "c", "d"))
    with pytest.raises(ValueError):
        agg.distinct_count_guard(lbl, "PROBABILITY", ("a", "b"))
    with pytest.raises(ValueError):
        agg.single_value_guard(lbl, "TYPE")
    assert agg.single_value_guard(lbl.where("TYPE = 'poly'"), "TYPE") == "poly"
    assert agg.image_shape(image_samples(spark, SF01), "SAMPLE_H", "SAMPLE_W", "SAMPLE_C") == (8, 8)
    mixed = spark.createDataFrame([(2, 2, 1), (2, 2, 3)], "height int, width int, nChannels int")
    with pytest.raises(ValueError):
        agg.image_shape(mixed)
    df, obs = agg.observe_count(lbl, "labels")
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == lbl.count()


def test_batch_infer_and_summary(spark):
    img = image_samples(spark, SF01)
    classes, cent = class_centroids(img, "SAMPLE", "CLASS")
    assert cent.shape == (10, 64)
    scored = batch_infer(img, "SAMPLE", centroid_predict_fn(cent), n_inputs=64)
    s = score_summary(scored, "probs", "CLASS", [f"c{c}" for c in classes])
    r = s.agg(F.avg(F.col("correct").cast("double")).alias("acc"), F.min("confidence"), F.max("confidence")).first()
    assert r["acc"] > 0.2 and 0 < r[1] <= r[2] <= 100


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and df.columns == ["LABEL_CATEGORY", "n_samples", "avg_chars", "avg_probability"]
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 60


def test_streaming_labels_equal_batch(spark):
    import __spark_entry__ as E

    s = E.queries()["stream_labels"](spark, SF001)
    b = label_frame(spark, SF001)
    assert sorted(map(tuple, s.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_streaming_labels_from_a_table_folder_and_from_partitions(spark, tmp_path):
    """A table that Spark wrote is a folder whose files have other names."""
    import __spark_entry__ as E

    rows = [(i, i % 3 / 2, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, quality double, toxic int")
    df.repartition(3).write.parquet(str(tmp_path / "labels.parquet"))
    got = E.queries()["stream_labels"](spark, str(tmp_path))
    b = label_frame(spark, str(tmp_path))
    assert b.count() == 20
    assert sorted(map(tuple, got.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))

    from panelscope.streaming import run_available, stream_labels

    df.withColumn("day", F.col("doc_id") % 2).write.partitionBy("day").parquet(str(tmp_path / "days"))
    days = run_available(stream_labels(spark, str(tmp_path / "days")), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert days.count() == 20


@pytest.mark.parametrize(
    "name",
    ["category_summary", "split_exact", "amplify", "merge_guard_report", "key_uniqueness", "ols_train_predict", "score_summary", "zfill"],
)
def test_oracle_parity(spark, name):
    """Spark result == DuckDB oracle on the same parquet tables (sf0.01)."""
    import duckdb

    import __spark_entry__ as E
    from panelscope.sources.tables import TABLES
    from tools.check_oracles import canon

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    df = E.queries()[name](spark, SF01)
    res = con.execute(E.oracle_sql()[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in res.description], res.fetchall())


def test_classify_defects_scores_rows_without_a_known_category(spark):
    from panelscope.operators.learn import classify_defects, with_features

    rows = [([float(i % 2), 1.0], "ab"[i % 2]) for i in range(20)]
    train = spark.createDataFrame(rows + [([0.5, 0.5], None)], "x array<double>, LABEL_CATEGORY string")
    model = classify_defects(train, "x")
    asked = spark.createDataFrame([([0.0, 1.0], "a"), ([1.0, 1.0], None), ([1.0, 1.0], "new")], "x array<double>, LABEL_CATEGORY string")
    got = model.transform(with_features(asked, "x")).collect()
    assert [r["prediction"] for r in got] == [0.0, 1.0, 1.0]
    assert all(len(r["probability"]) == 2 for r in got)


def test_a_fitted_model_scores_after_rows_were_counted(spark):
    from panelscope.operators.aggregates import observe_count
    from panelscope.operators.learn import classify_defects, with_features

    train = spark.createDataFrame([([float(i % 2), 1.0], "ab"[i % 2]) for i in range(20)], "x array<double>, LABEL_CATEGORY string")
    counted, seen = observe_count(train, "before")
    counted.collect()
    assert seen.get["rows"] == 20
    got = classify_defects(train, "x").transform(with_features(train, "x")).collect()
    assert all((r["prediction"] == 0.0) == (r["LABEL_CATEGORY"] == "a") for r in got)
