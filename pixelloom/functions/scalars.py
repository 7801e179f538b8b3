"""Scalar expressions over pixels, names and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U16_MAX = 65535


def to_uint16(v: Column) -> Column:
    """Clipped to 0..65535, then truncated; NaN is 0, null stays. Clipping comes first, so that no cast overflows."""
    v = v.cast("double")
    clipped = F.when(v > U16_MAX, float(U16_MAX)).when(v < 0, 0.0).otherwise(v)
    return F.when(F.isnan(v), F.lit(0)).otherwise(clipped.cast("int"))


def to_output(v: Column, dtype: str) -> Column:
    if dtype not in ("uint16", "float32"):
        raise ValueError(f"dtype must be uint16 or float32, not {dtype!r}")
    return to_uint16(v) if dtype == "uint16" else v.cast("float")


def positive(v: Column) -> Column:
    """v > 0; NaN, which Spark orders above all numbers, is not."""
    return (v > 0) & ~F.isnan(v.cast("double"))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def ceil_div(length: Column, pitch: Column) -> Column:
    return F.ceil(length / pitch).cast("long")


def value_type(value_bytes: Column) -> Column:
    """Name of the stored type; null for widths that are not supported."""
    return F.when(value_bytes == 2, "float16").when(value_bytes == 4, "float32").when(value_bytes == 8, "float64")


def display_timestamp(raw: Column) -> Column:
    """Wall-clock time as written, to the second; text that is no timestamp stays, null is empty."""
    trimmed = F.regexp_replace(raw, r"(\.\d{6})\d+", "$1")
    shape = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}).*$"
    return F.coalesce(F.when(trimmed.rlike(shape), F.regexp_replace(trimmed, shape, "$1 $2")).otherwise(raw), F.lit(""))


def short_description(d: Column, width: int = 35) -> Column:
    """Trimmed, empty for null, and at most ``width`` characters."""
    t = F.coalesce(F.trim(d), F.lit(""))
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t)


def overlay_name(d: Column, ix: Column) -> Column:
    return F.coalesce(F.when(d != "", d), F.concat(F.lit("ROI_"), ix.cast("string")))


def map_name(d: Column, ix: Column) -> Column:
    return F.coalesce(F.when(F.trim(d) != "", F.trim(d)), F.concat(F.lit("ROI_"), ix.cast("string")))


def stem(path: Column) -> Column:
    """File name without directories and the last suffix."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def subset_name(path: Column, filtered: bool, pyramid: bool) -> Column:
    """Output name of a channel subset: every ".ome" leaves the stem, operations are appended."""
    ops = "_".join([w for w, on in (("filtered", filtered), ("pyramid", pyramid)) if on])
    return F.concat(F.replace(stem(path), F.lit(".ome"), F.lit("")), F.lit(f"_{ops}.ome.tiff" if ops else ".ome.tiff"))
