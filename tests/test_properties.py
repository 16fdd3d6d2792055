"""Property tests: id expressions vs Python's regex and zfill; results that
must not depend on the number of shuffle partitions."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelscope.functions.ids import id_digits, id_prefix, id_suffix, zfill
from panelscope.operators.augment import amplify
from panelscope.operators.splits import split_exact
from panelscope.plans.common import IMG
from panelscope.sources.tables import image_samples, label_frame
from tests.conftest import SF001

ID_RE = re.compile(r"(?P<prefix>.*?)(?P<num>\d+)(?P<suffix>.*)")
ids = st.text(alphabet="ab._-/0123456789", min_size=0, max_size=14)


@settings(max_examples=1, deadline=None)
@given(st.lists(ids, min_size=30, max_size=30), st.lists(st.integers(0, 10**7), min_size=30, max_size=30), st.integers(1, 9))
def test_id_parts_and_zfill_match_python(spark, names, nums, width):
    df = spark.createDataFrame(list(zip(names, nums)), "k string, n long")
    got = df.select(id_prefix("k"), id_digits("k"), id_suffix("k"), zfill("n", width)).collect()
    for (name, n), row in zip(zip(names, nums), got):
        m = ID_RE.match(name)
        assert tuple(row[:3]) == ((m["prefix"], m["num"], m["suffix"]) if m else ("", "", ""))
        assert row[3] == str(n).zfill(width)


def _run(spark, parts, fn):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return sorted(map(tuple, fn().collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_same_result_with_1_4_64_partitions(spark):
    def split():
        return split_exact(label_frame(spark, SF001).select("LABEL_SAMPLE_ID"), 0.65, seed=3)

    def amp():
        a = amplify(image_samples(spark, SF001), IMG, [(0.25, 0.25)], (1,), (90,))
        return a.select("LABEL_SAMPLE_ID", F.col("SAMPLE").cast("array<double>"))

    for fn in (split, amp):
        results = [_run(spark, p, fn) for p in (1, 4, 64)]
        assert results[0] == results[1] == results[2]
