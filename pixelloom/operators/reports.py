"""Reports as rows of numbered lines: numbers come from DataFrames, and text is put together last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import scalars
from pixelloom.operators import geometry

# Wording, widths and decimals of the reports, and the names of corners in their order.
OVERLAY_MIN_PX = 4000
CORNERS = ["top_left", "top_right", "bottom_right", "bottom_left"]
RULE = "=" * 40
MAP_HEADS = {"stitched": "Stitched-ROIs to Panorama Mapping", "individual": "Individual-ROIs to Panorama Mapping"}
MAP_LINES = {
    "canvas_px": "stitched_canvas_pixels: %s x %s",
    "canvas_um": "stitched_canvas_slide_um: x_min=%s x_max=%s y_min=%s y_max=%s",
    "panorama_px": "panorama_pixels: %s x %s",
    "panorama_um": "panorama_slide_um: x_min=%s x_max=%s y_min=%s y_max=%s",
    "mapping": "corner_mapping (stitched corner -> panorama pixel):",
    "region": "--- %s ---",
    "dimensions": "  Dimensions: %sx%s px",
    "pixel": "  Pixel size: %s x %s um",
    "corners": "  Corners (panorama px):",
}
SUMMARY = {
    "file": "  MCD FILE: %s",
    "panoramas": "  PANORAMAS:",
    "panorama": "    %d: slide %d, pano %d: %s",
    "table": "  ROI TABLE:",
    "row": "    %-4s | %-35s | %-19s | %s",
    "size": "%4dx%-4d",
    "channels": " CHANNELS (%d): %s ",
}


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, ties to even by its exact value."""
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))


def _line(name: str, *values: Column) -> Column:
    return F.format_string(MAP_LINES[name], *(v.cast("string") for v in values))


def panorama_plan(flat: DataFrame, resolved: DataFrame, stem: str) -> DataFrame:
    """Which panoramas are written where, and whether an overlay is: only if both sides are long enough.

    ``resolved`` holds the decoded sizes by (slide_ix, pano_ix); without one the status is
    unresolved and nothing is written.
    """
    d = flat.join(resolved, ["slide_ix", "pano_ix"], "left")
    big = (F.col("width_px") >= OVERLAY_MIN_PX) & (F.col("height_px") >= OVERLAY_MIN_PX)
    path = F.concat(F.lit(f"{stem}_slide_"), F.col("slide_ix").cast("string"), F.lit("_pano_"), F.col("pano_ix").cast("string"), F.lit(".png"))
    return d.withColumns({"path": path, "overlay": F.coalesce(big, F.lit(False)), "status": F.when(F.col("width_px").isNull(), "unresolved").otherwise("ok")})


def _numbered(df: DataFrame, section: int, block: Column, lines: Column, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.lit(section).alias("section"), block.cast("long").alias("block"), F.posexplode(lines).alias("line", "text"))


def summary_lines(stem: str, rois: DataFrame, channels: list[str], panoramas: DataFrame) -> DataFrame:
    """The summary of a container: (section, block, line, text), in this order.

    ``rois`` are the selected regions by ``sel_ord``, ``channels`` those of the first of all regions.
    """
    one = rois.sparkSession.range(1)
    text = lambda *parts: F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    out = _numbered(one, 0, F.lit(0), text("", SUMMARY["file"] % stem), [])
    heads = panoramas.limit(1).select(F.lit(1).alias("one"))
    out = out.unionByName(_numbered(heads, 1, F.lit(-1), text("", SUMMARY["panoramas"]), []))
    row = F.format_string(SUMMARY["panorama"], "flat_ix", "slide_ix", "pano_ix", F.coalesce("description", F.lit("N/A")))
    out = out.unionByName(_numbered(panoramas, 1, F.col("flat_ix"), F.array(row), []))
    out = out.unionByName(_numbered(one, 2, F.lit(0), text(""), []))
    columns = SUMMARY["row"] % ("Idx", "Description", "Timestamp", f"{'Size (WxH)':<12}")
    heads = rois.limit(1).select(F.lit(1).alias("one"))
    out = out.unionByName(_numbered(heads, 3, F.lit(-1), text(SUMMARY["table"], columns, f"    {'-' * 4}-+-{'-' * 35}-+-{'-' * 19}-+-{'-' * 12}"), []))
    size = F.format_string(SUMMARY["size"], "width", "height")
    row = F.format_string(SUMMARY["row"], F.col("sel_ord").cast("string"), scalars.short_description(F.col("description")), scalars.display_timestamp(F.col("start_ts_raw")), size)
    out = out.unionByName(_numbered(rois, 3, F.col("sel_ord"), F.array(row), []))
    return out.unionByName(_numbered(one, 4, F.lit(0), text(" ", SUMMARY["channels"] % (len(channels), ", ".join(channels)), ""), []))


def channel_listing(labels: list[str]) -> list[str]:
    return [f"{i}: {name}" for i, name in enumerate(labels)]


def map_canvas(rois: DataFrame) -> DataFrame:
    """One row: canvas bounds, and its size in pixels (w, h) by the least pitch over x alone."""
    side = lambda a: F.ceil((F.col(f"c_max_{a}") - F.col(f"c_min_{a}")) / F.col("g_x"))
    return geometry.canvas(rois).withColumns({"w": side("x"), "h": side("y")})


def roi_map_lines(panoramas: DataFrame, rois: DataFrame, canvas: DataFrame | None = None, individual: bool = True) -> DataFrame:
    """The map file of each panorama: (flat_ix, section, block, line, text), in this order.

    ``panoramas`` are rows of ``panorama_bounds``, ``rois`` the regions by ``sel_ord``; the last of them
    come first. ``canvas`` (one row) adds the stitched canvas.
    """
    keys = ["flat_ix"]
    p = geometry.local(panoramas, send=True)  # a handful a file

    def pixel(label: Column, x: Column, y: Column, digits: int) -> Column:
        px, py = geometry.slide_to_panorama(x, y)
        return F.concat(label, F.lit(": "), fixed(px, digits), F.lit(", "), fixed(py, digits))

    head = lambda which: [F.lit(MAP_HEADS[which]), F.lit(RULE), F.lit("")]
    parts = []
    if canvas is not None:
        c = p.crossJoin(F.broadcast(canvas))
        bounds = [f"{end}_{axis}" for axis in "xy" for end in ("min", "max")]
        ends = [("min", "max"), ("max", "max"), ("max", "min"), ("min", "min")]
        lines = [
            *head("stitched"), _line("canvas_px", F.col("w"), F.col("h")), _line("canvas_um", *(fixed(F.col(f"c_{b}"), 3) for b in bounds)), _line("panorama_px", F.col("width_px"), F.col("height_px")),
            _line("panorama_um", *(fixed(F.col(f"p_{b}"), 1) for b in bounds)), F.lit(""), F.lit(MAP_LINES["mapping"]),
            *(pixel(F.lit(f"  {name}"), F.col(f"c_{ex}_x"), F.col(f"c_{ey}_y"), 3) for name, (ex, ey) in zip(CORNERS, ends, strict=True)), F.lit(""),
        ]
        parts.append(_numbered(c, 0, F.lit(0), F.array(*lines), keys))
    if individual or canvas is None:
        parts.append(_numbered(p, 1, F.lit(0), F.array(*head("individual")), keys))
        r = rois.select("sel_ord", scalars.map_name(F.col("description"), F.col("sel_ord")).alias("name"), "width", "height", "px_x", "px_y", F.col("corners").alias("points")).crossJoin(p)
        labels = F.array(*(F.lit(f"    {c}") for c in CORNERS))
        corners = F.transform(F.slice("points", 1, 4), lambda q, i: pixel(F.get(labels, i), q["x"], q["y"], 1))
        about = F.array(_line("region", F.col("name")), _line("dimensions", F.col("width"), F.col("height")), _line("pixel", fixed(F.col("px_x"), 4), fixed(F.col("px_y"), 4)), F.lit(MAP_LINES["corners"]))
        parts.append(_numbered(r, 2, -F.col("sel_ord"), F.concat(about, corners, F.array(F.lit(""))), keys))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def text_of(lines: DataFrame) -> str:
    """The lines of one report as text; they are gathered here, as a report has a few lines a region."""
    return "\n".join(r.text for r in lines.orderBy("section", "block", "line").collect())
