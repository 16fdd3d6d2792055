"""URL filters: host rules, and for the urls that no rule fits a weighted vocabulary.

An Aho-Corasick automaton finds all vocabulary terms of a url in one walk over
it; an occurrence counts if no ASCII letter or digit stands next to it. Terms
of weight 1 or more are strict, lighter ones soft: one strict term rejects, and
so do ``soft_least`` distinct soft ones. Counts and the weight of the distinct
terms are given beside the verdict.

Each url is judged where it is read: no shuffle, and a lost task is run again.
Rules and vocabulary are parameters of at most ``MOST`` entries each, sent to
the tasks once; the urls may be any number."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import fresh, read

MOST = 200_000
SOFT_LEAST = 2
#: Words of link farms, pill and casino shops, and adult sites. Strict: 1; soft: below 1.
VOCABULARY = {
    **dict.fromkeys(("spam-farm", "cheap-pills", "link-farm", "porn", "xxx", "viagra", "cialis", "online-casino", "payday-loans", "free-followers"), 1.0),
    **dict.fromkeys(("casino", "poker", "betting", "jackpot", "adult", "escort", "nude"), 0.5),
    **dict.fromkeys(("cheap", "pills", "pharmacy", "replica", "spam", "bonus", "loans", "seo", "backlinks", "followers"), 0.4),
}
#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
OUT = "rule string, verdict string, n_strict int, n_soft int, n_soft_distinct int, weight double"

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_JOINED = frozenset(string.ascii_lowercase + string.digits)


def lowered(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, up to ``/``, ``?``, ``#`` or the end, in lower case) and path (from there up to ``?``, ``#`` or the end). Null or without ``://``: both empty."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lowered(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def automaton(vocabulary: dict[str, float]):
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        found.add_word(term.translate(_LOWER), (term.translate(_LOWER), weight))
    if vocabulary:
        found.make_automaton()
    return found


def hits(found, url: str) -> Counter:
    """(term, weight) -> its occurrences in ``url`` that no letter or digit touches."""
    url, out = url.translate(_LOWER), Counter()
    if len(found):
        for last, (term, weight) in found.iter(url):
            if url[last + 1 : last + 2] not in _JOINED and (last < len(term) or url[last - len(term)] not in _JOINED):
                out[term, weight] += 1
    return out


def index_rules(rules: list[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    """host -> its (path, verdict), longest path first; of rules with equal host and path the first holds."""
    out: dict[str, dict[str, str]] = {}
    for host, path, verdict in rules:
        out.setdefault(host.translate(_LOWER), {}).setdefault(path, verdict)
    return {h: sorted(p.items(), key=lambda x: -len(x[0])) for h, p in out.items()}


def ruled(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, of equally long ones that with the longer host."""
    best = None
    while host:
        for p, verdict in rules.get(host, ()):
            if path.startswith(p):
                if best is None or len(host) + len(p) > len(best[0]):
                    best = (host + p, verdict)
                break
        host = host.partition(".")[2]
    return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, vocabulary: dict[str, float] = VOCABULARY, soft_least: int = SOFT_LEAST, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the longest
    rule that fits the url, else null), ``verdict`` (allow or block),
    ``n_strict`` and ``n_soft`` (occurrences), ``n_soft_distinct`` and
    ``weight`` (sum over the distinct terms).

    A rule fits its host and all subdomains, if the path starts with the
    rule's. Null and empty urls have no host, fit no rule, hold no term and are
    allowed. Input columns with the names of the new ones are replaced; all
    other columns and all rows (repeated ones too) stay. An empty table gives none."""
    if len(rules) > MOST or len(vocabulary) > MOST or "" in vocabulary:
        raise ValueError(f"at most {MOST} rules and {MOST} terms, none of them empty")
    shared = pages.sparkSession.sparkContext.broadcast((index_rules(rules), dict(vocabulary)))

    @F.pandas_udf(OUT)
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        by_host, terms = shared.value
        found = automaton(terms)
        for urls, hosts, paths in batches:
            rows = []
            for url, host, path in zip(urls, hosts, paths, strict=True):
                n = hits(found, url)
                strict = sum(c for (_, w), c in n.items() if w >= 1)
                soft = [c for (_, w), c in n.items() if w < 1]
                rule, verdict = ruled(by_host, host, path) or (None, "block" if strict or len(soft) >= soft_least else "allow")
                rows.append((rule, verdict, strict, sum(soft), len(soft), round(float(sum(w for _, w in n)), 6)))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "n_strict", "n_soft", "n_soft_distinct", "weight"])

    new = ["host", "path", "rule", "verdict", "n_strict", "n_soft", "n_soft_distinct", "weight"]
    at, host, path = fresh(pages, "url_judged", "url_host", "url_path")
    url = F.col(url_col).cast("string")
    got = pages.withColumns(dict(zip((host, path), parts(url), strict=True)))
    got = got.withColumn(at, verdicts(F.coalesce(url, F.lit("")), F.col(host), F.col(path)))
    kept = [c for c in pages.columns if c.lower() not in new]
    return got.select(*kept, F.col(host).alias("host"), F.col(path).alias("path"), f"{at}.*")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, and the vocabulary's counts, of each page's url."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def sql(rules: list[tuple[str, str, str]] = RULES, vocabulary: dict[str, float] = VOCABULARY, soft_least: int = SOFT_LEAST) -> str:
    """The query in SQL: boundary checks by a pattern for each term."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda h, p: f"(host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)})"
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    case = lambda out, rest: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {quote(out(h, p, v))}" for h, p, v in longest) + f" ELSE {rest} END"
    # a sign between two terms bounds both, so signs are doubled before terms are counted
    count = lambda t: f"len(regexp_extract_all(u, {quote('(?:^|[^a-z0-9])' + t.replace('-', '--') + '(?:$|[^a-z0-9])')}))"
    counts = ", ".join(f"{count(t)} AS t{i}" for i, t in enumerate(vocabulary))
    strict = [f"t{i}" for i, w in enumerate(vocabulary.values()) if w >= 1]
    soft = [f"t{i}" for i, w in enumerate(vocabulary.values()) if w < 1]
    weights = " + ".join(f"(t{i} > 0)::INT * {w}::DOUBLE" for i, w in enumerate(vocabulary.values()))
    return f"""
WITH r AS (SELECT page_id, regexp_replace(translate(coalesce(url, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '([^a-z0-9])', '\\1\\1', 'g') AS u,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {counts} FROM r),
n AS (SELECT page_id, host, path, ({" + ".join(strict)})::INT AS n_strict, ({" + ".join(soft)})::INT AS n_soft,
  ({" + ".join(f"({t} > 0)::INT" for t in soft)})::INT AS n_soft_distinct, round({weights}, 6) AS weight FROM p)
SELECT page_id, host, path, {case(lambda h, p, v: h + p, "NULL")} AS rule,
  {case(lambda h, p, v: v, f"CASE WHEN n_strict > 0 OR n_soft_distinct >= {soft_least} THEN 'block' ELSE 'allow' END")} AS verdict,
  n_strict, n_soft, n_soft_distinct, weight FROM n"""
