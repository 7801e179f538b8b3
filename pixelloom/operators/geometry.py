"""Canvas bounds, placement, polygons, and the map between slide and panorama."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.scalars import ceil_div


def bounds_of(corners: Column) -> dict[str, Column]:
    """min_x, max_x, min_y, max_y of an array of points."""
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)}


def canvas(rois: DataFrame) -> DataFrame:
    """One row: bounds over all corners, pitch ``g`` (least over both directions), and size in pixels."""
    b = rois.select("px_x", "px_y", *(c.alias(n) for n, c in bounds_of(F.col("corners")).items()))
    c = b.agg(F.min("min_x").alias("c_min_x"), F.max("max_x").alias("c_max_x"), F.min("min_y").alias("c_min_y"), F.max("max_y").alias("c_max_y"), F.min(F.least("px_x", "px_y")).alias("g"), F.min("px_x").alias("g_x"))
    return c.withColumns({"canvas_w": ceil_div(F.col("c_max_x") - F.col("c_min_x"), F.col("g")), "canvas_h": ceil_div(F.col("c_max_y") - F.col("c_min_y"), F.col("g"))})


#: Above so many rows a table of regions stays a plan instead of becoming a local table.
LOCAL_ROWS = 100_000


def local(regions: DataFrame, send: bool = False) -> DataFrame:
    """A table of one row a region, computed once: every use of it is then a small local table.

    With ``send`` it has a broadcast hint as well. A table that is too large stays as it is, without one.
    """
    rows = regions.limit(LOCAL_ROWS + 1).collect()
    if len(rows) > LOCAL_ROWS:
        return regions
    held = regions.sparkSession.createDataFrame(rows, regions.schema)
    return F.broadcast(held) if send else held


def translate(rois: DataFrame, bounds: DataFrame) -> DataFrame:
    """Corners relative to the canvas's least corner. ``bounds`` is one row, so it is sent to all."""
    return rois.crossJoin(F.broadcast(bounds)).withColumn("translated", F.transform("corners", lambda p: F.struct((p["x"] - F.col("c_min_x")).alias("x"), (p["y"] - F.col("c_min_y")).alias("y"))))


def place(rois: DataFrame, bounds: DataFrame) -> DataFrame:
    """Placement on the canvas: scaled size (h_new, w_new), offsets (x0, y0), and the clipped part.

    Offsets round half to even. y points up on slides and down on the canvas. A region that
    starts off the canvas keeps its leading rows and columns, moved to the edge.
    """
    t = translate(rois, bounds)
    mx, my = F.array_min(F.transform("translated", lambda p: p["x"])), F.array_min(F.transform("translated", lambda p: p["y"]))
    close = lambda p: F.abs(F.col(p) - F.col("g")) <= 1e-8 + 1e-5 * F.abs(F.col("g"))
    same = close("px_x") & close("px_y")
    t = t.withColumns({"mx": mx, "my": my, "same_pitch": same})
    scaled = lambda n, p: F.when(F.col("same_pitch"), F.col(n).cast("long")).otherwise(F.ceil(F.col(n) * (F.col(p) / F.col("g"))).cast("long"))
    t = t.withColumns({"h_new": scaled("max_y", "px_y"), "w_new": scaled("max_x", "px_x")})
    t = t.withColumns({"x0": F.rint(F.col("mx") / F.col("g")).cast("long"), "y0": F.col("canvas_h") - F.rint(F.col("my") / F.col("g")).cast("long") - F.col("h_new")})
    t = t.withColumns({"top": F.greatest(F.lit(0), "y0"), "left": F.greatest(F.lit(0), "x0"), "bottom": F.least("canvas_h", F.col("y0") + F.col("h_new")), "right": F.least("canvas_w", F.col("x0") + F.col("w_new"))})
    t = t.withColumn("polygon", F.transform("translated", lambda p: F.struct(((p["x"] - F.col("mx")) / F.col("g")).alias("x"), ((p["y"] - F.col("my")) / F.col("g")).alias("y"))))
    return with_mask(t)


def with_mask(regions: DataFrame) -> DataFrame:
    """What the mask of each region needs, once a region: ``is_rect`` and the box of its polygon, which only other shapes keep."""
    box = {f"box_{name}": c for name, c in bounds_of(F.col("polygon")).items()}
    t = regions.withColumns(box | {"is_rect": is_grid_rectangle(F.col("polygon"))})
    return t.withColumn("polygon", F.when(~F.col("is_rect"), F.col("polygon")))


MASK = ["polygon", "is_rect", "box_min_x", "box_max_x", "box_min_y", "box_max_y"]


def is_grid_rectangle(polygon: Column) -> Column:
    """Four corners on two distinct x and two distinct y: the mask is then two comparisons."""
    distinct = lambda axis: F.size(F.array_distinct(F.transform(polygon, lambda p: p[axis])))
    first = lambda axis, i: F.get(polygon, F.lit(i))[axis]
    diagonal = (first("x", 0) != first("x", 2)) & (first("y", 0) != first("y", 2))
    return (F.size(polygon) == 4) & (distinct("x") == 2) & (distinct("y") == 2) & diagonal


def point_in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    """Crossing number with half-open edges: points on a left or lower edge are in, on a right or upper one out."""
    n = F.size(polygon)

    def step(odd: Column, i: Column) -> Column:
        p, q = F.get(polygon, i), F.get(polygon, F.pmod(i + 1, n))
        spans = (p["y"] > y) != (q["y"] > y)
        # No division by zero: the quotient is only taken for edges that span y.
        at = F.when(spans, p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]))
        return odd != (spans & F.coalesce(x < at, F.lit(False)))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), step)


def in_polygon(x: Column, y: Column) -> Column:
    """The mask of regions with the columns ``MASK``; rectangles are two comparisons an axis."""
    boxed = (x >= F.col("box_min_x")) & (x < F.col("box_max_x")) & (y >= F.col("box_min_y")) & (y < F.col("box_max_y"))
    return boxed & (F.col("is_rect") | point_in_polygon(F.col("polygon"), x, y))


def panorama_bounds(panoramas: DataFrame) -> DataFrame:
    """Adds p_min_x.. from the corners, and ``box_status``: ok, missing or degenerate."""
    b = panoramas.withColumns({f"p_{n}": c for n, c in bounds_of(F.col("corners")).items()})
    known = F.coalesce(F.size("corners"), F.lit(0)) == 4
    known = known & ~F.exists("corners", lambda p: p["x"].isNull() | p["y"].isNull())
    flat = (F.col("p_max_x") == F.col("p_min_x")) | (F.col("p_max_y") == F.col("p_min_y"))
    return b.withColumn("box_status", F.when(~known, "missing").when(flat, "degenerate").otherwise("ok"))


def slide_to_panorama(x: Column, y: Column) -> tuple[Column, Column]:
    """Panorama pixel of a slide point, for rows of ``panorama_bounds``; null where the box is degenerate."""
    sx = F.col("width_px") / F.nullif(F.col("p_max_x") - F.col("p_min_x"), F.lit(0.0))
    sy = F.col("height_px") / F.nullif(F.col("p_max_y") - F.col("p_min_y"), F.lit(0.0))
    return (x - F.col("p_min_x")) * sx, (F.col("p_max_y") - y) * sy


def in_panorama(rois: DataFrame, panoramas: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Regions with their corners in panorama pixels (``points``), for each panorama; ``on`` names what they share.

    ``panoramas`` are rows of ``panorama_bounds``, a handful a slide: sent to all tasks as a local table.
    """
    p = local(panoramas, send=True)
    met = rois.join(p, on) if on else rois.crossJoin(p)

    def pixel(q):
        x, y = slide_to_panorama(q["x"], q["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return met.withColumn("points", F.transform("corners", pixel))


#: Colours of region outlines, in turn.
PALETTE = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255), (255, 128, 0), (128, 0, 255)]


def overlay_geometry(regions: DataFrame) -> DataFrame:
    """For rows with ``roi_ix`` and ``points`` (panorama pixels): colour, extent, line width, font size, centroid."""
    b = bounds_of(F.col("points"))
    mean = lambda axis: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[axis]) / F.size("points")
    colours = F.array(*(F.lit("#%02x%02x%02x" % c) for c in PALETTE))
    out = regions.withColumn("extent", F.greatest(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]))
    return out.withColumns(
        {
            "colour": F.element_at(colours, (F.pmod(F.col("roi_ix"), F.lit(len(PALETTE))) + 1).cast("int")),
            "line_width": F.greatest(F.lit(2), F.least(F.lit(10), (F.col("extent") / 100).cast("int"))),
            "font_size": F.greatest(F.lit(10), F.least(F.lit(192), (F.pow("extent", F.lit(0.7)) - 20).cast("int"))),
            "centre_x": mean("x"),
            "centre_y": mean("y"),
        }
    )
