"""DuckDB SQL fragments for the oracle queries (the same definitions as the
Spark stand-ins in :mod:`panelscope.sources.tables`)."""

from __future__ import annotations

from panelscope.functions.ids import ID_PATTERN
from panelscope.functions.scalars import LABEL_EDGES, LABEL_NAMES

RE = "'" + ID_PATTERN + "'"


def sid(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    return f"('cell' || lpad({s}, greatest(length({s}), 4)::INTEGER, '0') || '.png')"


def zfill(x: str, w: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    return f"lpad({s}, greatest(length({s}), {w})::INTEGER, '0')"


def bins(x: str, edges=LABEL_EDGES, names=LABEL_NAMES) -> str:
    parts = " ".join(
        f"WHEN {x} > {lo!r} AND {x} <= {hi!r} THEN '{n}'" for lo, hi, n in zip(edges, edges[1:], names)
    )
    return f"CASE {parts} END"


def pmod(a: str, b: str) -> str:
    return f"((({a}) % ({b}) + ({b})) % ({b}))"


LBL = f"""lbl0 AS (
  SELECT 'images/' || {sid('doc_id')} AS LABEL_PATH,
         'labels.csv' AS LABEL_FILENAME,
         (2.0::DOUBLE * (1 - quality) + toxic) / 3.0::DOUBLE AS PROBABILITY,
         CASE WHEN toxic = 1 THEN 'mono' ELSE 'poly' END AS TYPE
  FROM labels),
lbl AS (
  SELECT {bins('PROBABILITY')} AS LABEL_CATEGORY, LABEL_FILENAME, LABEL_PATH,
         regexp_extract(LABEL_PATH, '([^/]*)/*$', 1) AS LABEL_SAMPLE_ID, PROBABILITY, TYPE
  FROM lbl0)"""

SMP = f"""smp AS (
  SELECT {sid('doc_id')} AS LABEL_SAMPLE_ID,
         'samples/' || source || '/' || {sid('doc_id')} AS SAMPLE_PATH,
         'samples/' || source || '/' || {sid('doc_id')} AS SAMPLE_PATH_CATEGORY,
         lang, n_chars, 0 AS MIRROR_AXIS, 0 AS ROT_DEG, 0.0::DOUBLE AS TRANSL_X, 0.0::DOUBLE AS TRANSL_Y
  FROM documents)"""

MERGED = """mrg AS (
  SELECT * FROM lbl FULL OUTER JOIN smp USING (LABEL_SAMPLE_ID))"""

IMG = f"""img AS (
  SELECT {sid('vec_id')} AS LABEL_SAMPLE_ID, embedding AS SAMPLE,
         CAST(sqrt(len(embedding)) AS INTEGER) AS SAMPLE_H, CAST(sqrt(len(embedding)) AS INTEGER) AS SAMPLE_W,
         1 AS SAMPLE_C, label AS CLASS, 0 AS MIRROR_AXIS, 0 AS ROT_DEG, 0.0::DOUBLE AS TRANSL_X, 0.0::DOUBLE AS TRANSL_Y
  FROM embeddings)"""


def digest(arr: str) -> str:
    return f"round(list_reduce(list_transform({arr}, lambda x, i: x::DOUBLE * i::DOUBLE), lambda a, b: a + b), 6)"


def hash32(seed, key: str) -> str:
    return f"('0x' || substr(md5('{seed}' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


# ---- index maps as SQL text (same formulas as functions/pixels.py) --------

def mirror_src(axis, r, q, h, w):
    cases = {
        1: (f"({h} - 1 - ({r}))", q),
        2: (r, f"({w} - 1 - ({q}))"),
        3: (q, r),
        4: (f"({h} - 1 - ({q}))", f"({w} - 1 - ({r}))"),
    }
    if isinstance(axis, int):
        return (r, q) if axis == 0 else cases[axis]
    sr = "CASE " + " ".join(f"WHEN {axis} = {a} THEN {v[0]}" for a, v in cases.items()) + f" ELSE {r} END"
    sq = "CASE " + " ".join(f"WHEN {axis} = {a} THEN {v[1]}" for a, v in cases.items()) + f" ELSE {q} END"
    return sr, sq


def rotate_src(deg, r, q, h, w):
    cases = {
        90: (q, f"({w} - 1 - ({r}))"),
        180: (f"({h} - 1 - ({r}))", f"({w} - 1 - ({q}))"),
        270: (f"({h} - 1 - ({q}))", r),
    }
    if isinstance(deg, int):
        return (r, q) if deg % 360 == 0 else cases[deg % 360]
    sr = "CASE " + " ".join(f"WHEN {deg} = {a} THEN {v[0]}" for a, v in cases.items()) + f" ELSE {r} END"
    sq = "CASE " + " ".join(f"WHEN {deg} = {a} THEN {v[1]}" for a, v in cases.items()) + f" ELSE {q} END"
    return sr, sq


def translate_src(dx, dy, r, q, h, w):
    return pmod(f"({r}) - ({dy})", h), pmod(f"({q}) - ({dx})", w)


def permute(arr: str, n_side: str, src_fn) -> str:
    """Square single-channel image of side ``n_side``: output k reads arr[src(k)]."""
    r, q = f"(k // {n_side})", f"(k % {n_side})"
    sr, sq = src_fn(r, q, n_side, n_side)
    return f"list_transform(range(0, {n_side} * {n_side}), lambda k: {arr}[({sr}) * {n_side} + ({sq}) + 1])"


def amplify_sql(src: str, translations, axes, rotations, semantics: str = "documented", carry=("CLASS",)) -> str:
    """Closed-form amplification of the square images in CTE ``src`` (columns
    LABEL_SAMPLE_ID, SAMPLE, SAMPLE_H, metadata, ``carry``). Returns CTE text
    ending in ``amp``."""
    T, M, R = len(translations), len(axes), len(rotations)
    vals = []
    for vt, (x, y) in enumerate([(0.0, 0.0), *translations]):
        for vm, a in enumerate([0, *axes]):
            for vr, d in enumerate([0, *rotations]):
                vals.append(f"({vt}, {float(x)!r}, {float(y)!r}, {vm}, {a}, {vr}, {d})")
    n = "SAMPLE_H"
    dx = pmod(f"CAST(round_even({n} * tx, 0) AS BIGINT)", n)
    dy = pmod(f"CAST(round_even({n} * ty, 0) AS BIGINT)", n)

    def src_fn(r, q, h, w):
        if semantics == "observed":
            return mirror_src("axis", r, q, h, w)
        r, q = rotate_src("deg", r, q, h, w)
        r, q = mirror_src("axis", r, q, h, w)
        return translate_src("dx", "dy", r, q, h, w)

    mirror_col = "CASE WHEN vm > 0 THEN axis ELSE MIRROR_AXIS END" if semantics == "documented" else "MIRROR_AXIS"
    carried = "".join(f", {c}" for c in carry)
    return f"""p AS (
  SELECT *, regexp_extract(LABEL_SAMPLE_ID, {RE}, 1) AS pre, regexp_extract(LABEL_SAMPLE_ID, {RE}, 2) AS dg,
         regexp_extract(LABEL_SAMPLE_ID, {RE}, 3) AS suf FROM {src}),
st AS (SELECT count(*) AS n1, max(CAST(dg AS BIGINT)) AS m1, max(length(dg)) AS w1 FROM p),
c2 AS (SELECT *, n1 * {1 + T} AS n2, m1 + n1 * {T} AS m2 FROM st),
c2b AS (SELECT *, greatest(w1, length(CAST(m2 AS VARCHAR))) AS w2 FROM c2),
c3 AS (SELECT *, n2 * {1 + M} AS n3, m2 + n2 * {M} AS m3 FROM c2b),
c3b AS (SELECT *, greatest(w2, length(CAST(m3 AS VARCHAR))) AS w3 FROM c3),
rk AS (SELECT p.*, row_number() OVER (ORDER BY CAST(dg AS BIGINT), LABEL_SAMPLE_ID) AS r1 FROM p),
v AS (SELECT * FROM (VALUES {", ".join(vals)}) t(vt, tx, ty, vm, axis, vr, deg)),
e AS (SELECT * FROM rk CROSS JOIN v CROSS JOIN c3b),
f AS (SELECT *, vt * n1 + r1 AS r2 FROM e),
g AS (SELECT *, vm * n2 + r2 AS r3, {dx} AS dx, {dy} AS dy FROM f),
amp AS (
  SELECT CASE WHEN vr > 0 THEN pre || {zfill('m3 + (vr - 1) * n3 + r3', 'w3')} || suf
              WHEN vm > 0 THEN pre || {zfill('m2 + (vm - 1) * n2 + r2', 'w2')} || suf
              WHEN vt > 0 THEN pre || {zfill('m1 + (vt - 1) * n1 + r1', 'w1')} || suf
              ELSE LABEL_SAMPLE_ID END AS LABEL_SAMPLE_ID,
         CAST({mirror_col} AS INTEGER) AS MIRROR_AXIS,
         CAST(CASE WHEN vr > 0 THEN deg ELSE ROT_DEG END AS INTEGER) AS ROT_DEG,
         CAST(CASE WHEN vt > 0 THEN tx ELSE TRANSL_X END AS DOUBLE) AS TRANSL_X,
         CAST(CASE WHEN vt > 0 THEN ty ELSE TRANSL_Y END AS DOUBLE) AS TRANSL_Y{carried},
         {digest(permute('SAMPLE', n, src_fn))} AS px_digest
  FROM g)"""
