"""Dataset amplification: translated, mirrored and rotated copies with new,
collision-free ids.

Row order (which decides the new ids) is the numeric id, then the full id —
equal to the reference's order when ids share a prefix and are zero-padded.

Ids of the copies made by one stage: ``max + (v-1)*n + rank`` for variant
``v = 1..V`` over the ``n`` rows the stage copies, ``max`` being the largest id
number before the stage; padding width = the longest digit run before it.

``amplify`` (translate -> mirror -> rotate on un-amplified rows) does not run
three stages: with one ranking of the base rows every final row's id follows
in closed form, because a copy's rank in the next stage is ``v*n + rank``.
The variants are expanded with ``explode`` of a literal array (no shuffle, no
join), and the pixels of a final row are produced by one composed
permutation. Per-stage functions ``add_*`` serve partial or repeated calls.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.functions import pixels as px
from panelscope.functions.ids import add_to, digits_order, id_digits, id_prefix, id_suffix, zfill
from panelscope.functions.util import as_col
from panelscope.operators.aggregates import id_stats, id_stats_with
from panelscope.operators.ranking import range_rank
from panelscope.schema import KEY

# Fixed values that must equal the reference's for the same results.
# Effective default translations (x, y) — two pairs.
DEFAULT_TRANSLATIONS = ((0.25, 0.25), (-0.25, -0.25))
DEFAULT_MIRROR_AXES = (1, 2, 3, 4)
DEFAULT_ROTATIONS = (90, 180, 270)

_RANK, _N = "_am_rank", "_am_n"
META = ("MIRROR_AXIS", "ROT_DEG", "TRANSL_X", "TRANSL_Y")


@dataclass(frozen=True)
class ArrayImage:
    """Images as flat row-major arrays: column ``col``; shape from ints or column names."""

    col: str = "SAMPLE"
    h: object = "SAMPLE_H"
    w: object = "SAMPLE_W"
    c: object = "SAMPLE_C"

    def shape(self):
        return as_col(self.h), as_col(self.w), as_col(self.c)


@dataclass(frozen=True)
class StructImage:
    """Images as Spark image structs (bytes); pixels move in an Arrow kernel."""

    col: str = "SAMPLE"


# ---- parameter checks, when the plan is made --------------------------------

def check_translations(translations, semantics: str = "documented") -> tuple[tuple, ...]:
    if not isinstance(translations, Collection) or isinstance(translations, (str, bytes)):
        raise TypeError(f"translations is a list of (x, y) pairs, not {type(translations).__name__}.")
    out = []
    for t in translations:
        if not isinstance(t, Collection) or len(t) != 2:
            raise ValueError(f"A translation is a pair (x, y); {t!r} is none.")
        px.check_translation(t[0], semantics)
        px.check_translation(t[1], semantics)
        out.append((t[0], t[1]))
    return tuple(out)


def check_mirror_axes(axes) -> tuple[int, ...]:
    for a in axes:
        if a not in px.MIRROR_AXES:
            raise ValueError(f"There is no mirror axis {a}: 1 reverses rows, 2 columns, 3 and 4 swap along the diagonals.")
    return tuple(axes)


def check_rotations(rotations) -> tuple[int, ...]:
    for r in rotations:
        if r % 90 != 0:
            raise ValueError(f"Images turn by quarter turns (90 degrees); {r} degrees are not a number of them.")
    return tuple(sorted({r % 360 for r in rotations}))


def _is_int(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


# ---- pixel kernel for rows carrying their transformation parameters -------

def _apply_pixels(df: DataFrame, image, tx, ty, tx_int, ty_int, axis, deg, semantics: str, dataset_stage: bool = True, turn_square: bool = True) -> DataFrame:
    """Replace the image by rotate(mirror(translate(img))) with per-row
    parameters (Columns; 0 / NULL = operation not applied).

    ``semantics="observed"`` on a dataset stage reproduces the reference's
    discarded translation/rotation results (pixels kept); on a single
    translation (``dataset_stage=False``) it applies its axis rules. With ``turn_square``
    only square images may be turned; the diagonal mirrors always need one."""
    discard = semantics == "observed" and dataset_stage
    if image is None:  # metadata only: ids and amplification columns
        return df
    if px.check_image_column(df, image.col) == "struct":
        from panelscope.operators.images import geometry_kernel

        h = F.col(f"{image.col}.height")
        w = F.col(f"{image.col}.width")
        dx, dy = px.translation_shifts(tx, ty, tx_int, ty_int, h, w, semantics)
        if discard:
            dx, dy, deg = F.lit(0), F.lit(0), F.lit(0)
        return df.withColumn(image.col, geometry_kernel(F.col(image.col), dx, dy, axis, deg, turn_square))
    h, w, c = image.shape()
    c_static = image.c if isinstance(image.c, int) else None
    dx, dy = px.translation_shifts(tx, ty, tx_int, ty_int, h, w, semantics)
    if discard:  # translated / rotated pixels are discarded there
        dx, dy, deg = F.lit(0), F.lit(0), F.lit(0)
    needs_square = as_col(axis).isin(3, 4) | (as_col(deg) != 0) if turn_square else as_col(axis).isin(3, 4)
    geo = px.geometry_columns(h, w, axis, deg, dx, dy)
    moved = px.permute_affine(F.col(image.col), h, w, c_static if c_static is not None else c)
    checked = F.when(
        needs_square & (h != w) & (h * w > 1),
        F.raise_error(F.concat(F.lit("only a square image can be mirrored or turned like this, not one of "), h.cast("string"), F.lit("x"), w.cast("string"))),
    ).otherwise(moved)
    out = df.withColumns(geo).withColumn(image.col, checked)
    if not isinstance(image.h, int) and not isinstance(image.w, int):
        out = out.withColumns({image.h: F.col("_px_ho"), image.w: F.col("_px_wo")})
    return out.drop(*px.AFFINE_COLS)


# ---- new ids -----------------------------------------------------------------

def assign_new_ids(
    df: DataFrame,
    cur_max: int,
    width: int,
    key: str = KEY,
    variants: int = 1,
    num_buckets: int | None = None,
) -> DataFrame:
    """New ids for the rows of ``df`` (the rows to be added), in row order
    (numeric id, then id): ``prefix + zfill(cur_max + i, width) + suffix``,
    i = 1..n; prefix and suffix of each row are kept. With ``variants`` > 1
    the frame gets ``v`` = 1..variants copies, copy ``v`` numbered after the
    ``v-1`` earlier ones, so ids stay distinct across the whole batch."""
    ranked = id_ranked(df, key, num_buckets)
    if variants > 1:
        ranked = ranked.withColumn("_v", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    else:
        ranked = ranked.withColumn("_v", F.lit(1))
    num = add_to(cur_max, (F.col("_v") - 1) * F.col(_N) + F.col(_RANK))
    return ranked.withColumn(key, F.concat(id_prefix(F.col(key)), zfill(num, width), id_suffix(F.col(key)))).drop(_RANK, _N, "_v")


def id_ranked(df: DataFrame, key: str, num_buckets: int | None) -> DataFrame:
    """``df`` with each row's position in the order of the ids' numbers (of any length), then of the ids, and the row count."""
    return range_rank(df, [*digits_order(id_digits(F.col(key))), key], _RANK, num_buckets, _N)


def reference_id_stats(df: DataFrame, key: str = KEY, id_reference: DataFrame | None = None) -> tuple[int, int]:
    """(max id number, padding width) over ``df`` — or over ``id_reference``
    as well (e.g. the unfiltered dataset, so new ids cannot collide with
    rows outside the current filter)."""
    mx, w = _stats_row(df, key)
    if id_reference is not None:
        rm, rw = _stats_row(id_reference, key)
        mx, w = max(mx, rm), max(w, rw)
    return mx, w


# ---- stage-wise operators ---------------------------------------------------

def _need_digits(row) -> None:
    if row["n_without_digits"]:
        raise ValueError(f"New ids are numbered after the ids in the data, but {row['n_without_digits']} of these have no digits.")


def _stats_row(df: DataFrame, key: str):
    row = id_stats(df, key).first()
    _need_digits(row)
    return int(row["max_id"]), int(row["id_width"])


def _variant_array(variants: Sequence[dict]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in var.items()]) for var in variants])


def _add_stage(df, key, image, eligible: Column, variants: Sequence[dict], set_meta, semantics, num_buckets, id_reference=None):
    if image is not None:
        px.check_image_column(df, image.col)
    if not variants:
        return df
    cur_max, width = reference_id_stats(df, key, id_reference)
    ranked = id_ranked(df.filter(eligible), key, num_buckets)
    vs = [dict(v=i + 1, **var) for i, var in enumerate(variants)]
    # id parts once per source row, before the expansion
    copies = ranked.withColumns({"_pre": id_prefix(F.col(key)), "_suf": id_suffix(F.col(key))})
    copies = copies.withColumn("_var", F.explode(_variant_array(vs)))
    num = add_to(cur_max, (F.col("_var.v") - 1) * F.col(_N) + F.col(_RANK))
    copies = copies.withColumn(key, F.concat(F.col("_pre"), zfill(num, width), F.col("_suf")))
    copies = set_meta(copies)
    return df.unionByName(copies.select(*df.columns))


def add_translated(df, image, translations=DEFAULT_TRANSLATIONS, key: str = KEY, semantics="documented", num_buckets=None, id_reference=None):
    tr = check_translations(translations, semantics)
    variants = [dict(tx=float(x), ty=float(y), txi=_is_int(x), tyi=_is_int(y)) for x, y in tr]

    def set_meta(c):
        c = c.withColumns({"TRANSL_X": F.col("_var.tx"), "TRANSL_Y": F.col("_var.ty")})
        return _apply_pixels(c, image, F.col("_var.tx"), F.col("_var.ty"), F.col("_var.txi"), F.col("_var.tyi"), F.lit(0), F.lit(0), semantics)

    elig = (F.col("TRANSL_X") == 0) & (F.col("TRANSL_Y") == 0)
    return _add_stage(df, key, image, elig, variants, set_meta, semantics, num_buckets, id_reference)


def add_mirrored(df, image, mirror_axes=DEFAULT_MIRROR_AXES, key: str = KEY, semantics="documented", num_buckets=None, id_reference=None):
    axes = check_mirror_axes(mirror_axes)

    def set_meta(c):
        if semantics == "documented":
            c = c.withColumn("MIRROR_AXIS", F.col("_var.axis").cast("short"))
        return _apply_pixels(c, image, F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(False), F.col("_var.axis"), F.lit(0), semantics)

    return _add_stage(df, key, image, F.col("MIRROR_AXIS") == 0, [dict(axis=a) for a in axes], set_meta, semantics, num_buckets, id_reference)


def add_rotated(df, image, rotations=DEFAULT_ROTATIONS, key: str = KEY, semantics="documented", num_buckets=None, id_reference=None):
    rots = check_rotations(rotations)

    def set_meta(c):
        c = c.withColumn("ROT_DEG", F.col("_var.deg").cast("short"))
        return _apply_pixels(c, image, F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(False), F.lit(0), F.col("_var.deg"), semantics)

    return _add_stage(df, key, image, F.col("ROT_DEG") == 0, [dict(deg=d) for d in rots], set_meta, semantics, num_buckets, id_reference)


# ---- closed-form amplify ------------------------------------------------------

def stage_constants(n: int, max_id: int, width: int, n_t: int, n_m: int, n_r: int):
    """Per stage (copies made from ``n_s`` rows): (n_s, max before, width before)."""
    out = []
    for v in (n_t, n_m, n_r):
        out.append((n, max_id, width))
        max_id = max_id + n * v
        width = max(width, len(str(max_id)))
        n = n * (1 + v)
    return out


@dataclass(frozen=True)
class Amplification:
    """The base rows with their rank, and what follows from it for each variant.

    Made from narrow rows, it can be applied to the same rows with pixels
    (``expand(image, rows)``), so that images take no part in the ranking."""

    rows: DataFrame
    columns: tuple[str, ...]
    stages: tuple
    combos: tuple[dict, ...]
    key: str
    semantics: str

    def expand(self, image, rows: DataFrame | None = None) -> DataFrame:
        """All variants of ``rows`` (default: the ranked rows): ids, metadata and, unless ``image`` is None, pixels."""
        rows = self.rows if rows is None else rows
        columns = [c for c in rows.columns if c != _RANK]
        key, discard = self.key, self.semantics == "observed"
        (n1, m1, _), (n2, m2, _), (_, m3, _) = self.stages
        # id parts once per base row, before the expansion
        base = rows.withColumns({"_pre": id_prefix(F.col(key)), "_suf": id_suffix(F.col(key))})
        struct = image is not None and px.check_image_column(rows, image.col) == "struct"
        if struct:
            from panelscope.operators.images import expand_variants

            h, w = F.col(f"{image.col}.height"), F.col(f"{image.col}.width")
            moves = {c["vt"]: c for c in self.combos}
            still = (F.lit(0), F.lit(0))
            pairs = [still if discard or not vt else px.translation_shifts(F.lit(c["tx"]), F.lit(c["ty"]), F.lit(c["txi"]), F.lit(c["tyi"]), h, w, self.semantics) for vt, c in sorted(moves.items())]
            shifts = F.array(*[F.struct(x.cast("int").alias("dx"), y.cast("int").alias("dy")) for x, y in pairs])
            e = expand_variants(base, image.col, shifts, [(c["vt"], c["axis"], 0 if discard else c["deg"]) for c in self.combos], "_v")
            e = e.withColumn("_var", F.element_at(_variant_array(self.combos), F.col("_v") + 1))
        else:
            e = base.withColumn("_var", F.explode(_variant_array(self.combos)))
        vt, vm, vr, r1 = F.col("_var.vt"), F.col("_var.vm"), F.col("_var.vr"), F.col(_RANK)
        r2 = vt * F.lit(n1) + r1
        r3 = vm * F.lit(n2) + r2
        num1 = add_to(m1, (vt - 1) * F.lit(n1) + r1)
        num2 = add_to(m2, (vm - 1) * F.lit(n2) + r2)
        num3 = add_to(m3, (vr - 1) * F.lit(self.stages[2][0]) + r3)
        pre, suf = F.col("_pre"), F.col("_suf")
        w1, w2, w3 = (s[2] for s in self.stages)
        new_id = (
            F.when(vr > 0, F.concat(pre, zfill(num3, w3), suf))
            .when(vm > 0, F.concat(pre, zfill(num2, w2), suf))
            .when(vt > 0, F.concat(pre, zfill(num1, w1), suf))
            .otherwise(F.col(key))
        )
        meta = {
            key: new_id,
            "TRANSL_X": F.when(vt > 0, F.col("_var.tx")).otherwise(F.col("TRANSL_X")).cast("double"),
            "TRANSL_Y": F.when(vt > 0, F.col("_var.ty")).otherwise(F.col("TRANSL_Y")).cast("double"),
            "ROT_DEG": F.when(vr > 0, F.col("_var.deg")).otherwise(F.col("ROT_DEG")).cast("short"),
        }
        if self.semantics == "documented":
            meta["MIRROR_AXIS"] = F.when(vm > 0, F.col("_var.axis")).otherwise(F.col("MIRROR_AXIS")).cast("short")
        e = e.withColumns(meta)
        if image is not None and not struct:
            zero = F.lit(0)
            e = _apply_pixels(
                e,
                image,
                F.when(vt > 0, F.col("_var.tx")).otherwise(F.lit(0.0)),
                F.when(vt > 0, F.col("_var.ty")).otherwise(F.lit(0.0)),
                F.col("_var.txi"),
                F.col("_var.tyi"),
                F.when(vm > 0, F.col("_var.axis")).otherwise(zero),
                F.when(vr > 0, F.col("_var.deg")).otherwise(zero),
                self.semantics,
            )
        return e.select(*columns)


def untouched() -> Column:
    """Rows that are base rows: metadata all 0; rows without metadata (unmatched in an outer merge) are none."""
    plain = (F.col("TRANSL_X") == 0) & (F.col("TRANSL_Y") == 0) & (F.col("MIRROR_AXIS") == 0) & (F.col("ROT_DEG") == 0)
    return F.coalesce(plain, F.lit(False))


def amplification(
    df: DataFrame,
    translations=DEFAULT_TRANSLATIONS,
    mirror_axes=DEFAULT_MIRROR_AXES,
    rotations=DEFAULT_ROTATIONS,
    key: str = KEY,
    semantics: str = "documented",
    num_buckets: int | None = None,
    id_reference: DataFrame | None = None,
    stats=None,
) -> Amplification:
    """The amplification of ``df``, whose rows must all be base rows. One
    aggregate and one ranking; ``stats`` is the row of ``id_stats`` if known."""
    tr, axes, rots = check_translations(translations, semantics), check_mirror_axes(mirror_axes), check_rotations(rotations)
    if stats is None:
        stats = id_stats_with(df, key, F.count_if(~untouched()).alias("n_touched")).first()
        if stats["n_touched"]:
            raise ValueError(f"{stats['n_touched']} row(s) are amplified already or have no amplification metadata.")
    _need_digits(stats)
    n, m0, w0 = int(stats["n_rows"]), int(stats["max_id"]), int(stats["id_width"])
    if id_reference is not None:
        rm, rw = _stats_row(id_reference, key)
        m0, w0 = max(m0, rm), max(w0, rw)
    combos = []
    for vt, (x, y) in enumerate([(0, 0), *tr]):
        for vm, axis in enumerate([0, *axes]):
            for vr, deg in enumerate([0, *rots]):
                combos.append(dict(vt=vt, tx=float(x), ty=float(y), txi=_is_int(x), tyi=_is_int(y), vm=vm, axis=axis, vr=vr, deg=deg))
    stages = stage_constants(n, m0, w0, len(tr), len(axes), len(rots))
    ranked = id_ranked(df, key, num_buckets).drop(_N)
    return Amplification(ranked, tuple(df.columns), tuple(stages), tuple(combos), key, semantics)


def amplify(
    df: DataFrame,
    image,
    translations=DEFAULT_TRANSLATIONS,
    mirror_axes=DEFAULT_MIRROR_AXES,
    rotations=DEFAULT_ROTATIONS,
    key: str = KEY,
    semantics: str = "documented",
    num_buckets: int | None = None,
    id_reference: DataFrame | None = None,
) -> DataFrame:
    """translate -> mirror -> rotate; n rows become n(1+T)(1+M)(1+R).

    New ids start above the largest id of ``df`` (the reference's behaviour,
    D15) or, with ``id_reference``, above the largest of both frames."""
    if semantics not in ("documented", "observed"):
        raise ValueError(semantics)
    if image is not None:
        px.check_image_column(df, image.col)
    tr = check_translations(translations, semantics)
    axes = check_mirror_axes(mirror_axes)
    rots = check_rotations(rotations)
    srow = id_stats_with(df, key, F.count_if(~untouched()).alias("n_touched")).first()
    _need_digits(srow)
    if srow["n_touched"]:
        # rows that are amplified already, or have no metadata: the per-stage path handles eligibility
        out = add_translated(df, image, tr, key, semantics, num_buckets, id_reference)
        out = add_mirrored(out, image, axes, key, semantics, num_buckets)
        return add_rotated(out, image, rots, key, semantics, num_buckets)
    return amplification(df, tr, axes, rots, key, semantics, num_buckets, id_reference, srow).expand(image)
