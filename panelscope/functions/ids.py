"""Sample-id and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelscope.functions.util import as_col

# Fixed values that must equal the reference's for the same results.
# Id layout: lazy prefix, first run of digits, rest (matched from the start).
ID_PATTERN = r"^(.*?)([0-9]+)(.*)$"
# Raster image file extensions accepted as samples (lower case).
IMAGE_EXTENSIONS = (
    ".tif", ".tiff", ".png", ".bmp", ".raw", ".jfif", ".jif", ".jfi", ".jpe", ".jpeg",
    ".jpg", ".dib", ".gif", ".webp", ".arw", ".cr2", ".nrw", ".k25", ".heif", ".heic",
)


def id_prefix(c) -> Column:
    return F.regexp_extract(as_col(c), ID_PATTERN, 1)


def id_digits(c) -> Column:
    """First digit run of the id; '' when the id has no digit."""
    return F.regexp_extract(as_col(c), ID_PATTERN, 2)


def id_suffix(c) -> Column:
    return F.regexp_extract(as_col(c), ID_PATTERN, 3)


def id_number(c) -> Column:
    """Numeric value of the first digit run (bigint); NULL when there is none.
    A run too long for a bigint fails instead of counting as none."""
    d = id_digits(c)
    long_ = F.raise_error(F.concat(F.lit("id number beyond 64 bits: "), d)).cast("bigint")
    return F.when(d != "", F.coalesce(d.try_cast("bigint"), long_))


def digits_order(digits) -> tuple[Column, Column]:
    """Two sort keys that put digit strings of any length in the order of their
    numbers: the length without leading zeros, then the digits without them."""
    bare = F.ltrim(as_col(digits), F.lit("0"))
    return F.length(bare), bare


def add_to(number: int, offset) -> Column:
    """``number`` + ``offset`` (0 or more, below 2^63 - 10^18) as a digit string,
    for ``number`` of any size: the last 18 digits are added as a long, and their
    carry (0 to 9) chooses the digits before them."""
    high, low = divmod(number, 10**18)
    total = F.lit(low) + as_col(offset)
    if not high:
        return total.cast("string")
    heads = F.array(*[F.lit(str(high + c)) for c in range(10)])
    rest = total % F.lit(10**18)
    carry = ((total - rest) / F.lit(10**18)).cast("int")
    return F.concat(F.get(heads, carry), F.lpad(rest.cast("string"), 18, "0"))


def split_id(c) -> Column:
    """struct<prefix, digits, suffix>."""
    return F.struct(id_prefix(c).alias("prefix"), id_digits(c).alias("digits"), id_suffix(c).alias("suffix"))


def zfill(s, width) -> Column:
    """Left-pad with zeros to ``width``; never truncates (unlike ``lpad``)."""
    s = as_col(s).cast("string")
    w = F.greatest(F.length(s), as_col(width).cast("int"))
    return F.lpad(s, w, "0")


def concat_id(prefix, number, width, suffix) -> Column:
    return F.concat(as_col(prefix), zfill(as_col(number), width), as_col(suffix))


def basename(path) -> Column:
    """Last path component (trailing slashes ignored, as ``Path.name``)."""
    return F.regexp_extract(as_col(path), r"([^/]*)/*$", 1)


def url_basename(url) -> Column:
    """Basename of a URL path: query string and fragment are removed first."""
    return basename(F.regexp_replace(as_col(url), r"[?#].*$", ""))


def suffix_lower(path) -> Column:
    """Lower-cased extension of the file name ('' for none, '.bashrc' has none)."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def is_image_file(path, extensions=IMAGE_EXTENSIONS) -> Column:
    return suffix_lower(path).isin(list(extensions))
