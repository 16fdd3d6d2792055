import os

import pytest
from pyspark.sql import functions as F

from panelscope.functions.ids import basename, id_digits, is_image_file, suffix_lower, url_basename, zfill
from panelscope.functions.scalars import bin_code, bin_label
from panelscope.operators import aggregates as agg
from panelscope.sources.labels import scan_labels

LABEL_FILE = """\
images/cell0001.png  1.0                 mono
images/cell0002.png  0.0                 poly
# a comment line

images/cell0003.png  0.3333333333333333  poly   # trailing comment
images/cell0004.png  0.6666666666666666  polycrystalline
images/a_very_long_file_name_0005.png  0.5  mono
"""


def test_scan_labels_file(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "labels.csv")
    with open(p, "w") as fh:
        fh.write(LABEL_FILE)
    rows = {r["LABEL_SAMPLE_ID"]: r for r in scan_labels(spark, p).collect()}
    observed = {r["LABEL_SAMPLE_ID"]: r for r in scan_labels(spark, p, semantics="observed").collect()}
    assert set(observed) == {"cell0001.png", "cell0002.png", "cell0003.png", "cell0004.png", "a_very_long_"}
    assert len(observed["a_very_long_"]["LABEL_PATH"]) == 19 and observed["cell0004.png"]["TYPE"] == "poly"
    assert len(rows) == 5 and all(len(k) > len("a_very_long_") for k in set(rows) - set(observed))
    assert rows["cell0001.png"]["LABEL_CATEGORY"] == "fail"
    assert rows["cell0002.png"]["LABEL_CATEGORY"] == "pass"
    assert rows["cell0003.png"]["LABEL_CATEGORY"] == "minor_damage"
    assert rows["cell0004.png"]["LABEL_CATEGORY"] == "major_damage"
    assert rows["cell0003.png"]["LABEL_FILENAME"].endswith("labels.csv")
    assert [f.name for f in scan_labels(spark, p).schema.fields] == sorted(f.name for f in scan_labels(spark, p).schema.fields)


def test_scan_labels_missing_file(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        scan_labels(spark, os.path.join(tmpdir_path, "nope.csv"))


def test_bin_edges(spark):
    vals = [-0.1, 0.25, 0.2500001, 0.5, 0.75, 1.1, 1.2, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r[0] for r in df.select(bin_label("p")).collect()]
    assert got == [None, "pass", "minor_damage", "minor_damage", "major_damage", "fail", None, None, None]
    assert [r[0] for r in df.select(bin_code("p")).collect()][:6] == [None, 0, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        bin_label("p", edges=(0, 1), names=("a", "b"))


def test_id_rules(spark):
    df = spark.createDataFrame([("cell0009.png",), ("cell0003.png",)], "LABEL_SAMPLE_ID string")
    assert agg.max_sample_id(df) == 9 and agg.max_id_width(df) == 4
    df = spark.createDataFrame([("a1b22.png",)], "LABEL_SAMPLE_ID string")
    assert df.select(id_digits("LABEL_SAMPLE_ID")).first()[0] == "1"
    df = spark.createDataFrame([("cell9999.png", 9999 + 1)], "k string, n int")
    assert df.select(zfill("n", 4)).first()[0] == "10000"
    assert df.select(F.lpad(F.col("n").cast("string"), 3, "0")).first()[0] == "100"  # lpad truncates
    bad = spark.createDataFrame([("nodigits.png",)], "LABEL_SAMPLE_ID string")
    with pytest.raises(ValueError):
        agg.max_sample_id(bad)
    empty = spark.createDataFrame([], "LABEL_SAMPLE_ID string")
    assert agg.max_sample_id(empty) == 0


def test_paths(spark):
    df = spark.createDataFrame(
        [("a/b/c.PNG",), ("x/.bashrc",), ("dir/sub/",), ("img.tar.gz",), ("noext",)], "p string"
    )
    rows = df.select(basename("p"), suffix_lower("p"), is_image_file("p")).collect()
    assert [tuple(r) for r in rows] == [
        ("c.PNG", ".png", True), (".bashrc", "", False), ("sub", "", False), ("img.tar.gz", ".gz", False), ("noext", "", False)
    ]
    u = spark.createDataFrame([("https://x.example.org/en/25?page=2#top",)], "u string")
    assert u.select(url_basename("u")).first()[0] == "25"


def test_label_keys_stay_whole_for_long_ids(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "labels.csv")
    ids = [9_999, 10_000, 99_999, 100_000_000, 100_000_001, 100_000_010]
    with open(p, "w") as fh:
        fh.writelines(f"images/cell{i}.png 0.5 monocrystal\n" for i in ids)
    got = scan_labels(spark, p).collect()
    assert sorted(r["LABEL_SAMPLE_ID"] for r in got) == sorted(f"cell{i}.png" for i in ids)
    assert {r["TYPE"] for r in got} == {"monocrystal"}


def test_id_numbers_of_any_length(spark):
    from panelscope.operators.aggregates import max_id_width, max_sample_id
    from panelscope.operators.augment import ArrayImage, amplify, assign_new_ids

    ids = ["a0009.png", "a10.png", f"a{'9' * 30}.png", "a00.png", f"a000{10**29}.png", "a9.png", f"a{2**63}.png"]
    df = spark.createDataFrame([(i,) for i in ids], "LABEL_SAMPLE_ID string")
    assert (max_sample_id(df), max_id_width(df)) == (10**30 - 1, 33)
    number = lambda i: int(i[1:-4])
    new = assign_new_ids(df.withColumn("old", F.col("LABEL_SAMPLE_ID")), 10**30 - 1, 33, variants=2).collect()
    order = sorted(ids, key=lambda i: (number(i), i))
    want = {(o, f"a{10**30 - 1 + v * 7 + k:033d}.png") for v in (0, 1) for k, o in enumerate(order, 1)}
    assert {(r["old"], r["LABEL_SAMPLE_ID"]) for r in new} == want
    meta = {"SAMPLE": F.array(F.lit(1.0)), "MIRROR_AXIS": F.lit(0).cast("short"), "ROT_DEG": F.lit(0).cast("short"), "TRANSL_X": F.lit(0.0), "TRANSL_Y": F.lit(0.0)}
    grown = amplify(df.withColumns(meta), ArrayImage("SAMPLE", 1, 1, 1), translations=[(0.5, 0.5)], mirror_axes=(1,), rotations=(90,))
    got = {r["LABEL_SAMPLE_ID"] for r in grown.collect()}
    assert len(got) == 7 * 8 and f"a{10**30 - 1 + 49:033d}.png" in got
    assert max_sample_id(df.limit(0)) == 0
    with pytest.raises(ValueError, match="no digits"):
        max_sample_id(spark.createDataFrame([("x.png",)], "LABEL_SAMPLE_ID string"))

