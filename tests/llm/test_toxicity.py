import itertools
import random

import pytest
from pyspark.sql import functions as F

from panelscope.llm import toxicity as tox

STEMS = {"idiot": 4.0, "stup*": 3.0}


def test_composed_grammar_equals_the_transducers_in_turn():
    parts = [tox.aimed(), tox.threatening(), tox.negated(), tox.reported()]
    whole = tox.grammar()
    rng = random.Random(0)
    for text in itertools.chain(itertools.product("OGNRTI", repeat=4), ([rng.choice("OGNRTI") for _ in range(30)] for _ in range(200))):
        states, state = [0] * 4, 0
        for s in text:
            out, x = s, 1.0
            for k, fst in enumerate(parts):
                states[k], out, f = fst.get(states[k], {}).get(out, (states[k], out, 1.0))
                x *= f
            state, end, factor = whole[state][s]
            assert (end, factor) == (out, x)


def test_clauses():
    s = tox.Scorer(STEMS)
    w = lambda t: s.weigh(t)[0]
    plain = w("what an idiot.")
    assert plain == 4.0 and w("Stupidity") == 3.0 and w("") == w("nothing at all") == w("the idioms") == 0
    assert w("you are an idiot") > plain > w("he said: fine. she wrote what an idiot") > 0
    assert w("not an idiot") < plain and w("not. idiot") == plain
    assert w("I will kill you") == w("you we kill") == tox.THREAT_WEIGHT and w("kill the process") == 0
    assert s.weigh("idiot. fine. idiot!")[2] == 2
    assert w("idiot. " * 20_000) == 80_000.0


@pytest.fixture(scope="module")
def learned(spark):
    d = "/root/testdata/sf0.01"
    return tox.op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").collect()


def test_held_out_accuracy_on_given_tables(learned):
    held = [r for r in learned if r.held_out and r.toxic is not None]
    right = [r for r in held if r.predicted == r.toxic]
    assert len(learned) == 1000 and len(right) / len(held) > 0.95
    assert sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in learned)


def test_odd_rows(spark, docs_of):
    docs = docs_of([(1, "you idiot, you absolute idiot"), (2, None), (3, ""), (1, "you idiot, you absolute idiot"), (None, "fine words here")]).withColumnRenamed("lang", "weight")
    got = tox.score(docs, tox.Scorer(STEMS, (-3.0, 2.0, 0.0)))
    assert got.columns == [*docs.columns, "score"]
    assert sorted((r.doc_id or -1, r.score > 0.5) for r in got.collect()) == [(-1, False), (1, True), (1, True), (2, False), (3, False)]
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert tox.learn(docs, none).stems == {} and tox.learn(docs_of([]), none).stems == {}


def test_stage_keeps_clean_documents(spark, learned):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = tox.stage(spark, docs, d)
    assert kept.columns == docs.columns
    gone = docs.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id")).collect()
    assert {r.doc_id for r in gone} == {r.doc_id for r in learned if r.predicted}
