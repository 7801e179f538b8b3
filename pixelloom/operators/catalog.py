"""Regions, channels and panoramas: selection, order and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.indexspec import parse_indices

#: Fixed value: a message that callers match on.
NO_CHANNELS = "No valid channels selected"


def load_rois(acquisitions: DataFrame) -> DataFrame:
    """Acquisitions with a polygon, numbered newest first: ``roi_ix`` from 0 in each file.

    A missing timestamp sorts last and ties keep the catalogue's order.
    """
    order = Window.partitionBy("file_id").orderBy(F.desc_nulls_last("start_ts"), F.asc("catalog_ord"))
    return acquisitions.where(F.coalesce(F.size("corners"), F.lit(0)) > 0).withColumn("roi_ix", F.row_number().over(order) - 1)


#: An acquisition as the catalogue has it; its metadata are text.
ACQUISITION = (
    "struct<acq_id:string, description:string, corners:array<struct<x:double,y:double>>, px_x:double, px_y:double, width:int, height:int, "
    "channel_labels:array<string>, num_channels:int, metadata:map<string,string>>"
)
SLIDES = f"file_id string, slide_ix int, acquisitions array<{ACQUISITION}>"


def flat_record(slides: DataFrame) -> DataFrame:
    """Slides (``SLIDES``) to one row an acquisition, numbered through the file: ``catalog_ord``.

    Metadata that are missing or no number take the acquisition's size, 4 bytes a value and a pitch of 1.
    """
    a = slides.select("file_id", "slide_ix", F.posexplode("acquisitions").alias("pos", "a"))
    a = a.withColumn("catalog_ord", F.row_number().over(Window.partitionBy("file_id").orderBy("slide_ix", "pos")) - 1)
    m = lambda key: F.try_element_at(F.col("a.metadata"), F.lit(key))
    number = lambda name, key, kind, default: F.coalesce(m(key).try_cast(kind), default.cast(kind)).alias(name)
    return a.select(
        "file_id", "slide_ix", "catalog_ord", "a.acq_id", "a.description", m("StartTimeStamp").alias("start_ts_raw"), "a.corners", "a.px_x", "a.px_y", "a.width", "a.height",
        number("max_x", "MaxX", "int", F.col("a.width")), number("max_y", "MaxY", "int", F.col("a.height")), "a.channel_labels", F.coalesce("a.num_channels", F.size("a.channel_labels")).alias("num_channels"),
        m("DataStartOffset").try_cast("long").alias("data_start"), m("DataEndOffset").try_cast("long").alias("data_end"), number("value_bytes", "ValueBytes", "int", F.lit(4)),
        number("ablation_x", "AblationDistanceBetweenShotsX", "double", F.lit(1.0)), number("ablation_y", "AblationDistanceBetweenShotsY", "double", F.lit(1.0)),
    )


def select_rois(rois: DataFrame, spec: str | None = None) -> DataFrame:
    """Rows of ``rois`` that an index list names, with ``sel_ord``, the place in the list.

    None and "all" keep all, in order. An index that no region has raises ValueError, as does an
    empty list. The check is one job over a table of one row a region.
    """
    wanted = None if spec is None else parse_indices(spec)
    if wanted is None:
        return rois.withColumn("sel_ord", F.col("roi_ix"))
    if not wanted:
        raise ValueError("the region list is empty")
    last = rois.agg(F.max("roi_ix")).first()[0]
    parse_indices(spec, -1 if last is None else last)
    places = F.create_map(*(F.lit(x) for pair in zip(wanted, range(len(wanted)), strict=True) for x in pair))
    return rois.where(F.col("roi_ix").isin(wanted)).withColumn("sel_ord", F.element_at(places, F.col("roi_ix")))


def first_roi(rois: DataFrame, order: str = "sel_ord") -> DataFrame:
    return rois.orderBy(order).limit(1)


def select_channels(df: DataFrame, channels: list[int], ch: str = "ch") -> DataFrame:
    """Rows of the wanted channels, which are numbered anew from 0 in ascending order."""
    wanted = sorted(set(channels))
    if not wanted:
        raise ValueError(NO_CHANNELS)
    places = F.create_map(*(F.lit(x) for pair in zip(wanted, range(len(wanted)), strict=True) for x in pair))
    return df.where(F.col(ch).isin(wanted)).withColumn("new_ch", F.element_at(places, F.col(ch)))


def channel_names(labels: Column, channels: list[int]) -> Column:
    return F.array(*(F.get(labels, F.lit(i)) for i in channels))


def flatten_panoramas(panoramas: DataFrame) -> DataFrame:
    """Numbers panoramas over all slides of a file: ``flat_ix`` from 0."""
    return panoramas.withColumn("flat_ix", F.row_number().over(Window.partitionBy("file_id").orderBy("slide_ix", "pano_ix")) - 1)


def select_panoramas(flat: DataFrame, spec: str | None = None) -> DataFrame:
    """Panoramas that a list names; indices beyond the last are skipped."""
    wanted = None if spec is None else parse_indices(spec)
    return flat if wanted is None else flat.where(F.col("flat_ix").isin(wanted))
