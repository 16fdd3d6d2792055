import random
import re

import numpy as np

from panelscope.llm import anomaly


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, dup, seen = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {j for i, x in enumerate(tri) if tri.count(x) > 1 for j in (i, i + 1, i + 2)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep)]


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "a b c a b c", "x\ny\nx\n \n \nx", "é é # $$ <b>|", "漢字 \x0b 漢字\n漢字 \x0b 漢字", "\x1c a\x85b"]
    return out + [" ".join(rng.choice(["a", "b", "c\n", "\nd", "é", "##"]) for _ in range(rng.randrange(80))) for _ in range(60)]


def test_base_counts_equal_brute_force():
    for t in texts():
        assert anomaly.statistics(t or "")[:5] == brute(t), t


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (2000, 3)), [[9, 9, 9], [-8, 7, 0]]]
    s = anomaly.anomaly(anomaly.forest_of(x), x)
    assert set(np.argsort(s)[-2:]) == {2000, 2001} and 0 < s.min() and s.max() < 1
    assert (anomaly.anomaly(anomaly.forest_of(x[:0]), x) == 0.5).all()


def test_query(spark, docs_of, sf):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    docs = [(i, say(200) + ".\n" + say(80)) for i in range(400)]
    docs += [(400 + i, " ".join(w + "###" for w in say(200).split())) for i in range(60)]
    docs += [(460, None), (461, "short"), (462, "same words here " * 100), (1, say(100)), (None, say(100))]
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(0, 460, 2)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = anomaly.op6_quality_rules(spark, sf(documents=docs_of(docs), labels=labels)).collect()
    assert len(got) == len(docs)
    want = {(i, *brute(t)) for i, t in docs}
    assert {(r.doc_id, *(r[c] for c in anomaly.BASE)) for r in got} == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & set(range(400))) > 350 and not kept & set(range(400, 463))


def test_no_labels_and_no_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in anomaly.judge(docs_of([(1, "w " * 10), (2, " ".join(map(str, range(99))))]), none).orderBy("doc_id").collect()] == [False, True]
    assert anomaly.judge(docs_of([]), none).count() == 0
