"""Column-level functions (Spark SQL expressions, no Python per row)."""

from panelscope.functions.ids import (
    ID_PATTERN,
    basename,
    concat_id,
    id_digits,
    id_number,
    id_prefix,
    id_suffix,
    is_image_file,
    split_id,
    suffix_lower,
    url_basename,
    zfill,
)
from panelscope.functions.scalars import (
    argmax,
    bin_code,
    bin_label,
    floor_mod,
    gt_threshold,
    is_correct,
    isclose,
    max_conf,
    one_hot,
    predict_line,
    rescale,
    round_half_even,
    softmax,
)

__all__ = [
    "ID_PATTERN", "basename", "concat_id", "id_digits", "id_number", "id_prefix", "id_suffix",
    "is_image_file", "split_id", "suffix_lower", "url_basename", "zfill", "argmax", "bin_code",
    "bin_label", "floor_mod", "gt_threshold", "is_correct", "isclose", "max_conf", "one_hot",
    "predict_line", "rescale", "round_half_even", "softmax",
]
