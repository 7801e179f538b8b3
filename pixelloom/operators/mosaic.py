"""From pixel records to region images and the whole-slide mosaic, in sparse long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.scalars import positive, to_output
from pixelloom.operators.geometry import MASK, canvas, in_polygon, local, place

KEY = ["roi_id", "ch", "y", "x"]


def in_bounds(records: DataFrame, rois: DataFrame) -> DataFrame:
    """Records inside their region's cube, with coordinates truncated toward zero.

    The test is on the coordinates as they are, so that NaN, infinite and very large ones, which no integer
    holds, are outside.
    """
    inside = lambda c: (F.col(c).cast("double") > -1) & (F.col(c).cast("double") < F.col(f"max_{c}"))
    # One row a region, far below any broadcast limit; the join prunes regions that are not selected.
    small = rois.select("roi_id", "max_x", "max_y")
    kept = records.join(small, "roi_id").where(inside("x") & inside("y")).drop("max_x", "max_y")
    return kept.withColumns({c: F.col(c).try_cast("int") for c in ("x", "y")})


def unpivot(wide: DataFrame) -> DataFrame:
    """Wide records (roi_id, rec_ord, x, y, values) to one row a channel."""
    return wide.select("roi_id", "rec_ord", "x", "y", F.posexplode("values").alias("ch", "v"))


def scatter(records: DataFrame) -> DataFrame:
    """Cells (roi_id, ch, y, x, v): the record of the highest ordinal wins its cell.

    max_by over a bigint or a decimal is a hash aggregate with map-side combine.
    """
    return records.groupBy(*KEY).agg(F.max_by("v", "rec_ord").alias("v"))


def region_images(records: DataFrame, rois: DataFrame, dtype: str = "uint16") -> DataFrame:
    """Sparse images of each region in the output type; absent cells are 0."""
    return scatter(in_bounds(records, rois)).withColumn("v", to_output(F.col("v"), dtype))


def axis_weights(source: str, target: str):
    """Bilinear weights along one axis: structs (at, to, weight) for target size ``target`` from ``source``.

    Half-pixel centres; a neighbour beyond the edge is mirrored at the centre of the edge pixel, so that
    -1 is 1 and the size is the last but one.
    """

    def rows(size, size_new):
        def mirror(k):
            k = F.abs(k)
            return F.greatest(F.lit(0).cast("long"), F.least(k, 2 * (size.cast("long") - 1) - k))

        def one(i):
            c = (i + 0.5) * size / size_new - 0.5
            low = F.floor(c).cast("long")
            f = c - low
            return F.array(F.struct(mirror(low).alias("at"), i.alias("to"), (1 - f).alias("w")), F.struct(mirror(low + 1).alias("at"), i.alias("to"), f.alias("w")))

        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), size_new - 1), one))

    return rows(F.col(source), F.col(target))


def resample(cells: DataFrame, placed: DataFrame) -> DataFrame:
    """Cells on the global pitch. Regions of that pitch pass; others are interpolated bilinearly.

    Zeros add nothing to a weighted sum, so sparse cells meet small weight tables, one row a
    (size, target size, position), and no plane is made dense. Where no region differs nothing is joined.
    """
    kept = [F.col("v").cast("double").alias("v")]
    rest = placed.where(~F.col("same_pitch"))
    if not rest.take(1):
        return cells.select("roi_id", "ch", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *kept)

    def weights(axis: str, size: str, target: str) -> DataFrame:
        """Where each position goes, as an array."""
        w = rest.select(size, target).distinct().select(size, target, F.inline(axis_weights(size, target))).where("w > 0")
        return w.groupBy(size, target, F.col("at").alias(axis)).agg(F.collect_list(F.struct("to", "w")).alias(f"to_{axis}"))

    c = cells.join(placed.select("roi_id", "same_pitch", "max_x", "max_y", "h_new", "w_new"), "roi_id")
    c = c.withColumns({k: F.when(~F.col("same_pitch"), F.col(k)) for k in ("max_y", "max_x")})  # null: no weights to meet
    c = c.join(local(weights("y", "max_y", "h_new"), send=True), ["max_y", "h_new", "y"], "left").join(local(weights("x", "max_x", "w_new"), send=True), ["max_x", "w_new", "x"], "left")
    own = lambda axis: F.coalesce(f"to_{axis}", F.when(F.col("same_pitch"), F.array(F.struct(F.col(axis).cast("long").alias("to"), F.lit(1.0).alias("w")))))
    c = c.select("roi_id", "ch", "v", F.explode(own("y")).alias("ty"), own("x").alias("tx")).select("roi_id", "ch", "v", "ty", F.explode("tx").alias("tx"))
    return c.groupBy("roi_id", "ch", F.col("ty.to").alias("y"), F.col("tx.to").alias("x")).agg(F.sum(F.col("v").cast("double") * F.col("ty.w") * F.col("tx.w")).alias("v"))


def composite(cells: DataFrame, placed: DataFrame) -> DataFrame:
    """Canvas pixels (ch, y, x, v): cells in their polygon with a positive value, the last region in order wins."""
    info = placed.select("roi_id", "sel_ord", *MASK, "top", "left", "bottom", "right")
    c = cells.join(info, "roi_id").where(positive(F.col("v")))
    inside = (F.col("y") < F.col("bottom") - F.col("top")) & (F.col("x") < F.col("right") - F.col("left"))
    c = c.where(inside & in_polygon(F.col("x").cast("double"), F.col("y").cast("double")))
    c = c.select("ch", (F.col("top") + F.col("y")).alias("y"), (F.col("left") + F.col("x")).alias("x"), "v", F.col("sel_ord").cast("long").alias("o"))
    return c.groupBy("ch", "y", "x").agg(F.max_by("v", "o").alias("v"))


def mosaic(records: DataFrame, rois: DataFrame, dtype: str = "uint16", digits: int | None = None) -> DataFrame:
    """Whole-slide mosaic of the selected regions (with ``sel_ord``), sparse.

    Within a region the last record wins even if it is not positive, so the positivity filter
    follows the scatter. ``digits`` rounds resampled values before they are cast.
    """
    to_output(F.lit(0.0), dtype)
    placed = local(place(rois, canvas(rois)))
    cells = resample(scatter(in_bounds(records, placed)), placed)
    v = F.round("v", digits) if digits is not None else F.col("v")
    return composite(cells.withColumn("v", to_output(v, dtype)), placed)


def densify(cells: DataFrame, height: int, width: int, channels: int, keys: list[str] | None = None, images: DataFrame | None = None) -> DataFrame:
    """All cells of each image, absent ones 0. For sinks and checks; operators stay sparse.

    ``images`` names the images by ``keys``, those without a cell too; without it they are the cells' own.
    """
    keys = keys or []
    base = (cells if images is None else images).select(*keys).distinct() if keys else cells.sparkSession.range(1).drop("id")
    grid = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("ch"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return grid.join(cells, [*keys, "ch", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def pyramid(cells: DataFrame, levels: int = 4) -> DataFrame:
    """Strided decimation: level l keeps cells of which both coordinates divide by 2^l."""
    return cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("s", F.call_function("shiftleft", F.lit(1), F.col("level"))).where("y % s = 0 and x % s = 0").withColumns({"y": F.expr("y div s"), "x": F.expr("x div s")}).drop("s")


def tiles(cells: DataFrame, size: int = 256) -> DataFrame:
    """Tile keys (ty, tx) and places in the tile (iy, ix)."""
    return cells.withColumns({"ty": F.expr(f"y div {size}"), "tx": F.expr(f"x div {size}"), "iy": F.expr(f"y % {size}"), "ix": F.expr(f"x % {size}")})


def segment_check(segments: DataFrame, strict: bool = True) -> DataFrame:
    """Records in each segment, and a status: ok, partial (strict: no records) or unsupported width."""
    stride = (F.col("num_channels") + 3) * F.col("value_bytes")
    size = F.col("data_end") - F.col("data_start")
    legal = F.col("value_bytes").isin(2, 4, 8)
    whole = F.floor(size / stride)
    partial = size % stride != 0
    n = F.when(~legal, 0).when(partial & F.lit(strict), 0).otherwise(whole)
    return segments.withColumns({"n_records": n.cast("long"), "status": F.when(~legal, "unsupported").when(partial, "partial").otherwise("ok")})


def isolate(segments: DataFrame) -> DataFrame:
    """What reading each segment comes to, by itself: ok, recovered (whole records only) or skipped, with a message.

    ``file_size``, if there, is where the file ends; a segment beyond it keeps the records before.
    """
    known = "file_size" in segments.columns
    end = F.least("data_end", "file_size") if known else F.col("data_end")
    cut = (F.col("data_end") > F.col("file_size")) if known else F.lit(False)
    held = segments.withColumns({"whole_end": F.col("data_end"), "data_end": F.greatest(end, F.col("data_start")), "cut": cut})
    d = segment_check(held, strict=False).withColumn("data_end", F.col("whole_end")).drop("whole_end")
    status = F.when(F.col("status") == "unsupported", "skipped").when(F.col("cut") | (F.col("status") == "partial"), "recovered").otherwise("ok")
    message = F.when(F.col("status") == "unsupported", F.format_string("values of %d bytes are not supported", "value_bytes")).when(F.col("cut"), "the file ends before the segment").when(F.col("status") == "partial", "the segment ends within a record")
    return d.withColumns({"message": message, "status": status}).drop("cut")
