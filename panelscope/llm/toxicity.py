"""Toxicity by a weighted finite-state pattern grammar.

The grammar reads a clause as a string of symbols: insult, threat, target,
negation, reported speech, other. Small transducers each handle one matter:
a target near an insult marks it as aimed, a threat counts only with a target
near it, a negation shortly before weakens, reported speech before weakens for
the rest of the clause. They are composed once into one transducer, whose
output symbols carry the weights; a clause's score is the weight of what it
puts out. Clauses without a match score 0. The least match is an insult that
no target stands before: it counts in full, an aimed one by a quarter more. Counting
aimed ones alone misses most toxic texts of the given kind, whose insults stand among words
of no language (README).

Which words are insults, and how heavy, is learnt: word stems that stand in
more differing contexts of toxic labelled texts than of others, by the
likelihood ratio, with the log odds as weight. Contexts (the neighbours
and the word) rather than occurrences are counted, so copies count once. The
fit reads at most ``FIT_TOXIC`` + ``FIT_CLEAN`` labelled rows, and keeps at
most ``STEMS`` stems; a logistic curve on the summed weight, and on the weight
a word, turns it into a score from 0 to 1. All texts are scored whole."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import crc_mod, prepare, read, table, text_key, text_of

#: Bounds of the fit: labelled rows of each kind, and stems kept.
FIT_TOXIC, FIT_CLEAN, STEMS = 3000, 4000, 2000
#: Prefix lengths tried; least root of the likelihood ratio, least log odds, least number of texts.
SHORTEST, LONGEST, LEAST_G, LEAST_ODDS, LEAST_DOCS = 3, 9, 4.5, math.log(6), 2
CUT = 0.7

#: Function words of the grammar in four languages.
TARGETS = "you your you're u he she they them him her these those people du dich dir ihr euch sie dein er tu te toi vous ton ta il elle ils usted ustedes él ella ellos tú".split()
NEGATIONS = "not no never nobody isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca ningún sin".split()
REPORTS = "said says say called calls wrote writes quoted quote reported alleged claimed sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
THREATS = "kill murder hurt destroy beat shoot stab strangle burn töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")


# ---------------------------------------------------------------- transducers

#: state -> input symbol -> (next state, output symbol, weight factor). A symbol that is not listed keeps the state and passes unchanged.
Fst = dict[int, dict[str, tuple[int, str, float]]]


def aimed(reach: int = 4) -> Fst:
    """Marks insults and threats that follow a target within ``reach`` symbols: I -> A, T -> V."""
    out: Fst = {0: {"G": (reach, "G", 1.0)}}
    for k in range(1, reach + 1):
        out[k] = {"G": (reach, "G", 1.0), "I": (k - 1, "A", 1.25), "T": (k - 1, "V", 1.0)} | {s: (k - 1, s, 1.0) for s in "ONR"}
    return out


def threatening(reach: int = 4) -> Fst:
    """A threat that no target precedes counts if one follows within ``reach``: the target then puts it out (V)."""
    out: Fst = {0: {"T": (reach, "O", 1.0)}}
    for k in range(1, reach + 1):
        out[k] = {"G": (0, "V", 1.0), "T": (reach, "O", 1.0)} | {s: (k - 1, s, 1.0) for s in "OIAVNR"}
    return out


def negated(reach: int = 3) -> Fst:
    """Weakens what follows a negation within ``reach`` symbols."""
    out: Fst = {0: {"N": (reach, "N", 1.0)}}
    for k in range(1, reach + 1):
        out[k] = {"N": (reach, "N", 1.0)} | {s: (k - 1, s, 0.25) for s in "IAV"} | {s: (k - 1, s, 1.0) for s in "OGRT"}
    return out


def reported() -> Fst:
    """Weakens what follows a verb of saying, to the clause's end."""
    return {0: {"R": (1, "R", 1.0)}, 1: {s: (1, s, 0.5) for s in "IAV"}}


def compose(first: Fst, second: Fst) -> Fst:
    """The transducer that feeds the output of the first to the second; factors multiply."""
    symbols = "OGNRTIAV"
    states = {(0, 0): 0}
    todo, out = [(0, 0)], {}
    while todo:
        a, b = todo.pop()
        row = {}
        for s in symbols:
            a2, mid, x = first.get(a, {}).get(s, (a, s, 1.0))
            b2, end, y = second.get(b, {}).get(mid, (b, mid, 1.0))
            if (a2, b2) not in states:
                states[a2, b2] = len(states)
                todo.append((a2, b2))
            row[s] = (states[a2, b2], end, x * y)
        out[states[a, b]] = row
    return out


def grammar() -> Fst:
    return compose(compose(compose(aimed(), threatening()), negated()), reported())


THREAT_WEIGHT = 2.0


class Lexicon(dict):
    """word -> weight as an insult (0: none): that of its longest stem. Stems end in * if they are prefixes."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems

    def __missing__(self, word: str) -> float:
        found = self.stems.get(word, 0.0)
        if not found:
            for k in range(min(LONGEST, len(word) - 1), SHORTEST - 1, -1):
                if found := self.stems.get(word[:k] + "*", 0.0):
                    break
        if len(self) > 60_000:
            self.clear()
        self[word] = found
        return found


class Scorer:
    def __init__(self, stems: dict[str, float], curve: tuple[float, ...] = (-3.0, 1.0, 0.0)):
        self.stems, self.curve = stems, curve

    def __getstate__(self):
        return self.stems, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def ready(self):
        if not hasattr(self, "fst"):
            self.lexicon, self.fst = Lexicon(self.stems), grammar()
            self.symbols = {w: s for s, ws in (("T", THREATS), ("R", REPORTS), ("N", NEGATIONS), ("G", TARGETS)) for w in ws}
            self.threats = set(THREATS)

    def clause(self, words: list[str]) -> float:
        """The weight of a clause: of its symbols as the composed transducer puts them out."""
        state, total = 0, 0.0
        for w in words:
            x = self.lexicon[w]
            state, end, factor = self.fst[state]["I" if x else self.symbols.get(w, "O")]
            if end in "IA":
                total += x * factor
            elif end == "V":
                total += THREAT_WEIGHT * factor
        return total

    def weigh(self, text: str) -> tuple[float, int, int]:
        """The text's weight, its words, and its matched clauses."""
        self.ready()
        low = text.lower()
        words = WORD.findall(low)
        seen = set(words)
        if not any(map(self.lexicon.__getitem__, seen)) and not seen & self.threats:
            return 0.0, len(words), 0
        got = [x for c in CLAUSE.split(low) if c and (x := self.clause(WORD.findall(c)))]
        return sum(got), len(words), len(got)

    def score(self, text: str) -> float:
        weight, n, _ = self.weigh(text)
        x = sum(a * b for a, b in zip(self.curve, shape(weight, n), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def shape(weight: float, words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(weight), math.log1p(100 * weight / max(words, 20))


# ------------------------------------------------------------------- learning

def evidence(texts: DataFrame) -> DataFrame:
    """(stem, toxic, contexts, docs) of the columns text and toxic: distinct contexts with the stem, and texts (by distinct text)."""

    def emit(batches):
        for batch in batches:
            for text, toxic, doc in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = ["", *WORD.findall(text.lower()), ""]
                rows = set()
                for x, w, y in zip(words, words[1:], words[2:], strict=False):
                    at = number(f"{x} {w} {y}")
                    rows.add((w, at))
                    rows.update((w[:k] + "*", at) for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
                if rows:
                    stems, ctx = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(stems), pa.array(ctx, pa.int64()), pa.array([toxic] * len(rows), pa.int32()), pa.array([doc] * len(rows), pa.int64())], ["stem", "ctx", "toxic", "doc"])

    rows = texts.select(text_of(), F.col("toxic").cast("int"), F.xxhash64(text_of())).mapInArrow(emit, "stem string, ctx long, toxic int, doc long")
    once = rows.groupBy("stem", "toxic", "ctx").agg(F.min("doc").alias("doc"))
    return once.groupBy("stem", "toxic").agg(F.count(F.lit(1)).alias("contexts"), F.approx_count_distinct("doc").alias("docs"))


def number(s: str) -> int:
    """A context as a number, the same in every worker process."""
    return xxhash.xxh64_intdigest(s) - 2**63


def stems_of(found: DataFrame, most: int = STEMS) -> dict[str, float]:
    """The stems that mark toxic texts, with their log odds; among a stem and longer ones of no better odds, the stem alone."""
    total = {r["toxic"]: r["n"] for r in found.where(~F.col("stem").endswith("*")).groupBy("toxic").agg(F.sum("contexts").alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        return {}
    one = lambda v, c: F.sum(F.when(F.col("toxic") == v, F.col(c)).otherwise(0))
    by = found.groupBy("stem").agg(one(1, "contexts").alias("t"), one(0, "contexts").alias("c"), one(1, "docs").alias("d"))
    share = total[1] / (total[0] + total[1])
    n = F.col("t") + F.col("c")
    part = lambda x, p: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (n * p))).otherwise(0.0)
    by = by.withColumn("g", F.sqrt(F.greatest(F.lit(0.0), 2 * (part("t", share) + part("c", 1 - share)))))
    odds = F.log((F.col("t") + 0.5) / (total[1] + 1)) - F.log((F.col("c") + 0.5) / (total[0] + 1))
    by = by.withColumn("odds", odds).where((F.col("d") >= LEAST_DOCS) & (F.col("g") >= LEAST_G) & (F.col("odds") >= LEAST_ODDS))
    rows = by.orderBy(F.desc("g"), "stem").limit(most).collect()  # bounded
    odds_of, times = ({r["stem"]: r[c] for r in rows} for c in ("odds", "t"))
    for stem in sorted(odds_of, key=len, reverse=True):  # nearly always the start of one longer stem: that one says it better
        for k in range(SHORTEST, len(stem.rstrip("*"))):
            if (p := stem[:k] + "*") in odds_of and times[stem] >= 0.9 * times[p]:
                del odds_of[p]
    kept: dict[str, float] = {}
    for stem in sorted(odds_of, key=lambda s: (len(s.rstrip("*")), s)):
        word = stem.rstrip("*")
        shorter = [odds_of[p] for k in range(SHORTEST, len(word) + 1) if (p := word[:k] + "*") in kept and p != stem]
        if not shorter or odds_of[stem] > max(shorter) + 1.0:
            kept[stem] = odds_of[stem]
    return kept


def fit_curve(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = (-3.0, 1.0, 0.0), strength: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps, drawn towards the prior curve."""
    p0 = np.array(prior)
    w = p0.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - p0)
        hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def sample(docs: DataFrame, labels: DataFrame, use: Callable[[str], Column]) -> DataFrame:
    """(text, toxic): at most FIT_TOXIC and FIT_CLEAN labelled rows with ``use(doc_id)``, by a hash of their id."""
    known = labels.where("toxic is not null and doc_id is not null").where(use("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit("fit"))
    most = lambda v, n: known.where((F.col("toxic") > 0) == F.lit(v)).orderBy(draw, "doc_id").limit(n)
    ids = most(True, FIT_TOXIC).unionByName(most(False, FIT_CLEAN)).select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    got = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).join(F.broadcast(ids), "id").select("text", "toxic")
    return got.where("text is not null")


def learn(docs: DataFrame, labels: DataFrame, use: Callable[[str], Column] = lambda c: F.lit(True)) -> Scorer:
    """A scorer from the labelled rows (doc_id, toxic) for which ``use(doc_id)`` holds. Without labels of both kinds it knows no insults."""
    prepare(docs.sparkSession)
    rows = table(sample(docs, labels, use), "toxic-fit")
    spark = rows.sparkSession
    rows = rows.repartition(max(4, spark.sparkContext.defaultParallelism))
    scorer = Scorer(stems_of(table(evidence(rows), "stems")))
    shared = spark.sparkContext.broadcast(scorer)

    @F.pandas_udf("weight double, words long")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.weigh(t)[:2] for t in texts], columns=["weight", "words"])

    got = rows.groupBy(text_key().alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("toxic", weigh("text").alias("w")).select("toxic", "w.*").toPandas()  # bounded by the sample
    x = np.array([shape(a, b) for a, b in zip(got["weight"], got["words"], strict=True)]).reshape(-1, 3)
    return Scorer(scorer.stems, fit_curve(x, got["toxic"].to_numpy(float)))


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1. Null and empty texts have no clauses
    and get the least score. Repeated rows are scored alike; a column ``out`` is replaced."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t or "") for t in texts], dtype="float64")

    return docs.withColumn(out, of_texts(text_of(text_col)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; learnt from rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = learn(docs, read(spark, sf_dir, "labels"), lambda c: crc_mod(c, 3) != 1)
    got = score(docs, scorer)
    return got.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score CUT or more go."""
    scorer = learn(docs, read(spark, sf_dir, "labels"), lambda c: crc_mod(c, 3) != 1)
    return score(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), scorer).where(F.col("score") < CUT).select("row.*")
