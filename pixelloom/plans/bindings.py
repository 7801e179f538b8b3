"""Regions, records, panoramas and cubes bound to the star-schema tables, for queries and checks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_CHANNELS = 7
#: Corner offsets: a rectangle, and one with two corners cut.
SHAPES = {
    0: [(0.0, 0.0), (40.0, 0.0), (40.0, 30.0), (0.0, 30.0)],
    1: [(8.5, 0.0), (40.0, 0.0), (40.0, 21.5), (31.5, 30.0), (0.0, 30.0), (0.0, 8.5)],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corners(ox: Column, oy: Column, shape: list) -> Column:
    return F.array(*(F.struct((ox + dx).alias("x"), (oy + dy).alias("y")) for dx, dy in shape))


def acquisitions(spark: SparkSession, sf_dir: str, mixed_pitch: bool = False) -> DataFrame:
    """One acquisition a nation. With ``mixed_pitch``, every third has pixels of 2 um and a half-pixel origin."""
    n = F.col("n_nationkey")
    coarse = (n % 3 == 0) & F.lit(mixed_pitch)
    shift = F.when(coarse, 0.5).otherwise(0.0)
    d = table(spark, sf_dir, "nation").select(
        F.lit("nation").alias("file_id"), n.cast("int").alias("roi_id"), n.cast("int").alias("catalog_ord"), F.col("n_regionkey").cast("int").alias("slide_ix"), n.cast("string").alias("acq_id"), F.col("n_name").alias("description"),
        ((n * 12) % 25).cast("int").alias("start_ts"), ((n % 5) * 30.0 + shift).alias("ox"), (F.floor(n / 5) * 25.0 + shift).alias("oy"), F.when(coarse, 2.0).otherwise(1.0).alias("px_x"),
    )
    corners = F.when(d["roi_id"] % 4 < 2, _corners(d["ox"], d["oy"], SHAPES[0])).otherwise(_corners(d["ox"], d["oy"], SHAPES[1]))
    w, h = (40 / F.col("px_x")).cast("int"), (30 / F.col("px_x")).cast("int")
    labels = F.array(*(F.lit(f"CH{c}") for c in range(N_CHANNELS)))
    return d.withColumns({"corners": corners, "px_y": F.col("px_x"), "width": w, "height": h, "max_x": w, "max_y": h, "channel_labels": labels, "num_channels": F.lit(N_CHANNELS)})


def ordinal(lineitem: DataFrame) -> Column:
    """A record's ordinal: order key * 10^13 + part key * 10^8 + price in cents.

    It is a bigint, as in SQL, where every row's sum is one with all its parts; else a decimal, which holds the
    same number. A row whose terms are all within a quarter of the range is never looked at: the comparisons
    with columns are pushed down, so that files of small keys are skipped by their statistics.
    """
    order, part, price = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_extendedprice")
    cents = F.round(price * 100).cast("long")
    beyond = lambda c, most: (c > most) | (c < -most)
    large = beyond(order, 2**61 // 10**13) | beyond(part, 2**61 // 10**8) | beyond(price, 2.0**61 / 100)
    by_order, by_part = order.cast("decimal(20,0)") * Decimal(10**13), part.cast("decimal(20,0)") * Decimal(10**8)
    whole = (by_order + by_part + cents.cast("decimal(20,0)")).cast("decimal(38,0)")
    fits = lambda c: c.between(-(2**63), 2**63 - 1)
    # The first look is cheap to plan, and for small keys it is the only one.
    if lineitem.where(large).take(1) and lineitem.where(large & ~(fits(by_order) & fits(by_part) & fits(by_order + by_part) & fits(whole))).take(1):
        return whole
    return order * 10**13 + part * 10**8 + cents


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pixel records; the scans read only the columns named here."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    su = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("roi_id"))
    return li.join(su, "l_suppkey").select(
        "roi_id", (F.col("l_linenumber") - 1).cast("int").alias("ch"), (F.col("l_partkey") % 42).cast("int").alias("x"), (F.col("l_orderkey") % 31).cast("int").alias("y"),
        (F.col("l_extendedprice") - 2000).alias("v"), ordinal(li).alias("rec_ord"),
    )


def panoramas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One panorama a region; the box grows with the key, sides are 3000 + 500 key pixels."""
    r = F.col("r_regionkey")
    lo_x, hi_x, lo_y, hi_y = -10.0 - r, 170.0 + 2 * r, -5.0 - r, 140.0 + 3 * r
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return table(spark, sf_dir, "region").select(
        F.lit("region").alias("file_id"), r.cast("int").alias("slide_ix"), F.lit(0).alias("pano_ix"), F.col("r_name").alias("description"),
        F.array(point(lo_x, hi_y), point(hi_x, hi_y), point(hi_x, lo_y), point(lo_x, lo_y)).alias("corners"), (3000 + 500 * r).cast("int").alias("width_px"), (3000 + 500 * r).cast("int").alias("height_px"),
    )


def cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 plane a vector, scaled to thousandths; the label's parity is its channel."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.pmod(F.col("vec_id"), F.lit(5)).cast("int").alias("ch"), F.posexplode("embedding").alias("pos", "value"))
    return e.select("image_id", "ch", F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.floor(F.col("value").cast("double") * 1000).cast("long").alias("v"))
