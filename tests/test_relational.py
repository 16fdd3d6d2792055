"""Schema operators, the label ⨝ sample merge and its guards, filters, set ops."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope import schema as S
from panelscope.operators.filters import Dataset, data_by_label, filter_rows, label_prefix, not_equal_keep_missing
from panelscope.operators.joins import merge_labels_samples
from panelscope.operators.setops import except_by_key, key_uniqueness
from panelscope.operators.projections import key_first, project_labels


def test_schema_names_and_order():
    with pytest.raises(ValueError):
        S.make_schema(S.field("bad name", T.StringType()))
    with pytest.raises(ValueError):
        S.make_schema(S.field("a", T.StringType()), S.field("a", T.IntegerType()))
    assert [f.name for f in S.SCHEMA_FULL_ELPV.fields] == sorted(f.name for f in S.SCHEMA_FULL_ELPV.fields)
    assert S.SCHEMA_FULL_ELPV["TRANSL_X"].dataType == T.DoubleType()
    assert S.SCHEMA_FULL_ELPV["LABEL_SAMPLE_ID"].metadata["doc"]


def test_merge_schemas_conflict():
    a = S.make_schema(S.field("k", T.StringType(), "left"), S.field("x", T.IntegerType()))
    b = S.make_schema(S.field("k", T.StringType(), "right"), S.field("y", T.DoubleType()))
    m = S.merge_schemas(a, b)
    assert [f.name for f in m.fields] == ["k", "x", "y"] and m["k"].metadata["doc"] == "right"
    with pytest.raises(ValueError):
        S.merge_schemas(a, S.make_schema(S.field("x", T.StringType())))


def test_check_and_cast(spark):
    df = spark.createDataFrame([("1", "2.5", "zz"), ("x", None, "7")], "a string, b string, c string")
    sch = S.make_schema(S.field("a", T.IntegerType()), S.field("b", T.DoubleType()))
    with pytest.raises(ValueError):
        S.check_schema(df, sch)
    out = S.cast_to_schema(df, sch)
    assert out.columns == ["a", "b", "c"]
    S.check_schema(out, sch)
    assert [tuple(r) for r in out.collect()] == [(1, 2.5, "zz"), (None, None, "7")]
    assert S.cast_failures(df, sch).first().asDict() == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        S.assert_castable(df, sch)
    assert S.empty_from_schema(spark, sch).count() == 0


def _labels(spark, keys):
    return spark.createDataFrame([(k, 0.5) for k in keys], "LABEL_SAMPLE_ID string, PROBABILITY double")


def _samples(spark, keys):
    return spark.createDataFrame([(k, f"p/{k}") for k in keys], "LABEL_SAMPLE_ID string, SAMPLE_PATH string")


def test_merge_guards(spark):
    with pytest.raises(ValueError, match="each sample needs one label"):
        merge_labels_samples(_labels(spark, ["a", "b"]), _samples(spark, ["a"]))
    # equal counts but not one-to-one: passes the reference's guard, not strict
    m = merge_labels_samples(_labels(spark, ["a", "b"]), _samples(spark, ["a", "c"]), sort=True)
    assert [r["LABEL_SAMPLE_ID"] for r in m.collect()] == ["a", "b", "c"]
    assert m.columns[0] == "LABEL_SAMPLE_ID"
    with pytest.raises(ValueError, match="one-to-one"):
        merge_labels_samples(_labels(spark, ["a", "b"]), _samples(spark, ["a", "c"]), check="strict")
    ints = spark.createDataFrame([(1, "x")], "LABEL_SAMPLE_ID int, SAMPLE_PATH string")
    with pytest.raises(ValueError):
        merge_labels_samples(_labels(spark, ["a"]), ints)
    merge_labels_samples(_labels(spark, ["a", "b"]), _samples(spark, ["b", "a"]), check="strict")


def test_full_outer_filter_becomes_outer_join_with_pushdown(spark):
    m = merge_labels_samples(_labels(spark, ["a", "b"]), _samples(spark, ["a", "c"]), check="none")
    f = filter_rows(m, "PROBABILITY > 0.1")
    assert sorted(r[0] for r in f.select("LABEL_SAMPLE_ID").collect()) == ["a", "b"]
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan


def test_filter_errors_and_cumulative(spark):
    df = _labels(spark, ["a", "b", "c"]).withColumn("TYPE", F.when(F.col("LABEL_SAMPLE_ID") == "a", "mono").otherwise("poly"))
    with pytest.raises(ValueError, match="NOPE"):
        filter_rows(df, "NOPE > 1")
    with pytest.raises(ValueError):
        filter_rows(df, "TYPE ==")
    ds = Dataset(df).filter("TYPE == 'poly'").filter("LABEL_SAMPLE_ID != 'b'")
    assert [r[0] for r in ds.current.select("LABEL_SAMPLE_ID").collect()] == ["c"]
    assert ds.reset().current.count() == 3
    nulls = spark.createDataFrame([("a",), (None,)], "t string")
    assert nulls.where(not_equal_keep_missing("t", F.lit("a"))).count() == 1


def test_data_by_label_and_prefix(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 0.5), ("d", 0.005)], "LABEL_SAMPLE_ID string, PROBABILITY double")
    sets = {(r[0], r[1]) for r in data_by_label(df).select("LABEL_SAMPLE_ID", "label_set").collect()}
    assert sets == {("a", "prob_one"), ("a", "prob_positive"), ("b", "prob_zero"), ("c", "prob_positive")}
    cats = spark.createDataFrame([("pass",), ("minor_damage",), ("major_damage",)], "LABEL_CATEGORY string")
    assert label_prefix(cats, "m").count() == 2


def test_set_ops(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1)], "k string, v int")
    assert sorted(r[0] for r in key_uniqueness(df, "k").collect()) == ["a", "c"]
    part = spark.createDataFrame([("a", 1)], "k string, v int")
    assert sorted(r[0] for r in except_by_key(df, part, "k").collect()) == ["c"]
    assert key_first(df, "v").columns == ["v", "k"]


def test_key_uniqueness_hot_key(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(8)
    assert key_uniqueness(df, "k").count() == 6000


def test_project_labels_order(spark):
    m = merge_labels_samples(_labels(spark, ["a"]), _samples(spark, ["a"]))
    assert project_labels(m).columns == ["LABEL_SAMPLE_ID", "PROBABILITY"]


def test_merge_refuses_many_to_many(spark):
    with pytest.raises(ValueError, match="every pair"):
        merge_labels_samples(_labels(spark, ["a", "a", "b"]), _samples(spark, ["a", "a", "c"]))
    with pytest.raises(ValueError, match="every pair"):
        merge_labels_samples(_labels(spark, ["a", "a"]), _samples(spark, ["a", "a", "c"]), check="pairs")
    # repeated on one side only: allowed (rows are not multiplied)
    m = merge_labels_samples(_labels(spark, ["a", "a", "b"]), _samples(spark, ["a", "c"]), check="pairs")
    assert m.count() == 4


def test_merge_with_a_hot_key_equals_the_plain_one(spark, monkeypatch):
    from panelscope.operators import joins

    labels = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), (None, 3)], "LABEL_SAMPLE_ID string, l int")
    samples = spark.createDataFrame([("hot", 1.0), ("a", 2.0), ("warm", 3.0), (None, 4.0)] + [("b", float(i)) for i in range(40)], "LABEL_SAMPLE_ID string, s double")
    plain = joins.merge_labels_samples(labels, samples, check="pairs")
    assert "FullOuter" in plain._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(joins, "HOT_KEY", 30)
    split = joins.merge_labels_samples(labels, samples, check="pairs")
    assert "FullOuter" not in split._jdf.queryExecution().optimizedPlan().toString()
    assert split.schema == plain.schema
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
