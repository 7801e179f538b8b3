"""Entry points: convert regions, stitch them, process containers, and subset the images made.

A container is a raw file ``<stem>.mcd`` with a catalogue ``<stem>.json`` beside it: its slides,
their acquisitions (with byte ranges of pixel segments) and panoramas. The vendor's own catalogue
format is not parsed. Pixels are decoded, composited and cast by Spark; a task compresses one plane of an
image, from sparse cells, and a short one puts the planes of an image together.
"""

from __future__ import annotations

import base64
import json
import os
import time
import traceback
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import scalars
from pixelloom.functions.indexspec import parse_channels, parse_indices
from pixelloom.operators import catalog, geometry, mosaic, reports
from pixelloom.sources import ome, png, tiff
from pixelloom.sources.segments import read_segments_safely, resolve_inputs, resolve_tiffs

PANO_SCHEMA = "file_id string, slide_ix int, pano_ix int, description string, corners array<struct<x:double,y:double>>, width_px int, height_px int"
DTYPES = {"uint16": ("<u2", "uint16"), "float32": ("<f4", "float")}


def session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _check_options(dtype: str, compression: str | None) -> None:
    if dtype not in DTYPES:
        raise ValueError(f"output type must be uint16 or float32, not {dtype!r}")
    tiff.compression_name(compression)


class Container:
    """The catalogue of one file as tables: ``rois`` (numbered, newest first) and ``panoramas``."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.path = spark, Path(path)
        self.raw = json.loads(self.path.with_suffix(".json").read_text(encoding="utf-8"))
        slides, panos = [], []
        self.images: dict[tuple[int, int], np.ndarray | None] = {}
        for k, slide in enumerate(self.raw["slides"]):
            slides.append((self.path.stem, k, [self._acquisition(a) for a in slide.get("acquisitions", [])]))
            for j, p in enumerate(slide.get("panoramas") or []):
                image = p.get("image_png")
                self.images[k, j] = png.read_png(base64.b64decode(image)) if image else None
                size = self.images[k, j].shape if image else (None, None)
                m = p.get("metadata", {})
                xy = [(m.get(f"SlideX{i}PosUm"), m.get(f"SlideY{i}PosUm")) for i in range(1, 5)]
                corners = None if any(v is None for c in xy for v in c) else [(float(x), float(y)) for x, y in xy]
                panos.append((self.path.stem, k, j, m.get("Description"), corners, size[1], size[0]))
        flat = catalog.flat_record(spark.createDataFrame(slides, catalog.SLIDES)).withColumn("roi_id", F.col("catalog_ord"))
        table = flat.withColumn("start_ts", F.try_to_timestamp(F.regexp_replace("start_ts_raw", r"(\.\d{6})\d+", "$1")))
        self.rois = geometry.local(catalog.load_rois(table))
        self.panoramas = geometry.local(catalog.flatten_panoramas(spark.createDataFrame(panos, PANO_SCHEMA)))

    @staticmethod
    def _acquisition(a: dict) -> tuple:
        corners = [(float(x), float(y)) for x, y in a.get("roi_points_um") or []]
        size = [float(a["pixel_size_x_um"]), float(a["pixel_size_y_um"]), int(a["width_px"]), int(a["height_px"])]
        return (str(a["id"]), a.get("description"), corners, *size, list(a["channel_labels"]), a.get("num_channels"), {k: str(v) for k, v in a.get("metadata", {}).items() if v is not None})

    def records(self, rois: list, say=print) -> DataFrame:
        """Long records of the given region rows; only their byte ranges are read."""
        if lost := [r.description for r in rois if r.data_start is None or r.data_end is None]:
            raise ValueError(f"regions without a byte range: {lost}")
        segments = [dict(roi_id=r.roi_id, data_start=r.data_start, data_end=r.data_end, value_bytes=r.value_bytes, num_channels=r.num_channels, name=r.description) for r in rois]
        wide, warnings = read_segments_safely(self.spark, str(self.path), segments)
        for w in warnings:
            say(f"  {w}")
        return mosaic.unpivot(wide)


def _groups(batches: Iterator[pa.RecordBatch], keys: int):
    """(key, iterator of its batches) of rows sorted by their first ``keys`` columns; each iterator must be used up."""

    def pieces():
        for b in batches:
            own = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
            cuts = [0, *(np.flatnonzero(np.diff(own, axis=1).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    yield tuple(own[:, lo].tolist()), b.slice(lo, hi - lo)

    rest = pieces()
    ahead = next(rest, None)
    while ahead is not None:
        key = ahead[0]

        def same(key=key):
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                yield ahead[1]
                ahead = next(rest, None)

        yield key, same()


def _part(path: str, channel: int) -> str:
    return f"{path}.plane-{channel}"


def write_images(cells: DataFrame, images: list[dict], dtype: str, compression: str | None, levels: int = 1) -> int:
    """One file an image: ``cells`` (image, ch, y, x, v), ``images`` dicts of path, xml, channels, shape.

    Tasks by image and channel each hold one plane and write its compressed blocks beside the image; a task
    an image then copies them, in channel order, into the file. Both rename what they have finished, so a task
    that is lost and runs again leaves the same files.
    """
    spark, kind = cells.sparkSession, np.dtype(DTYPES[dtype][0])
    for i in images:
        Path(i["path"]).parent.mkdir(parents=True, exist_ok=True)
    # A marker row for each plane, so that one without a positive cell is written as well.
    marks = spark.createDataFrame([(k, c, -1, 0, 0.0) for k, i in enumerate(images) for c in range(i["channels"])], "image int, ch int, y long, x long, v double")
    own = cells.select(F.col("image").cast("int"), F.col("ch").cast("int"), F.col("y").cast("long"), F.col("x").cast("long"), F.col("v").cast("double"))
    planes = sum(i["channels"] for i in images)
    dealt = marks.unionByName(own).repartition(max(1, min(planes, 10_000)), "image", "ch").sortWithinPartitions("image", "ch")

    def compress(batches):
        for (k, c), parts in _groups(batches, 2):
            i = images[k]
            plane = np.zeros(i["shape"], kind)
            for b in parts:
                y, x, v = (b.column(n).to_numpy(zero_copy_only=False) for n in (2, 3, 4))
                real = y >= 0
                plane[y[real], x[real]] = v[real]
            if c >= i["channels"]:
                continue
            part = f"{_part(i['path'], c)}-{os.getpid()}"
            with open(part, "wb") as f:
                made = tiff.write_blocks(tiff.strided_levels(plane, levels), f, compression)
            os.replace(part, _part(i["path"], c))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c], pa.int32()), pa.array([json.dumps(made)])], ["image", "ch", "blocks"])

    def join(batches):
        for (k,), parts in _groups(batches, 1):
            i = images[k]
            made = sorted((c, text) for b in parts for c, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            part = f"{i['path']}.part-{os.getpid()}"
            with open(part, "wb") as f:
                writer = tiff.BigTiffWriter(f, compression)
                for c, text in made:
                    with open(_part(i["path"], c), "rb") as source:
                        writer.append([(tuple(shape), counts) for shape, counts in json.loads(text)], kind, source, i["xml"] if c == 0 else None)
            os.replace(part, i["path"])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())], ["image"])

    blocks = dealt.mapInArrow(compress, "image int, ch int, blocks string")
    written = blocks.repartition(max(1, min(len(images), 10_000)), "image").sortWithinPartitions("image").mapInArrow(join, "image int").count()
    for i in images:  # only once all images are whole
        for c in range(i["channels"]):
            Path(_part(i["path"], c)).unlink(missing_ok=True)
    return written


def convert(input_path, output_path=None, dtype="uint16", compression="zstd", out_dir=None, silent=False, container: Container | None = None, rois: DataFrame | None = None) -> int:
    """One OME-TIFF a region, named by its description; gives the number of regions."""
    _check_options(dtype, compression)
    say = (lambda *a: None) if silent else print
    path = Path(input_path)
    c = container or Container(session(), path)
    chosen = (rois if rois is not None else catalog.select_rois(c.rois)).orderBy("sel_ord")
    rows = chosen.collect()  # one row a region
    if not rows:
        say(f"  No ROIs found in {path.name}")
        return 0
    names = [r.description for r in rows]
    if twice := {str(n) for n in names if names.count(n) > 1}:
        raise ValueError(f"several regions would be written to one file: {sorted(twice)}")
    folder = Path(out_dir) if out_dir else Path(output_path) / path.stem if output_path else path.parent / "MCD_Converted" / path.stem
    images = []
    for r in rows:
        out = folder / f"{r.description}.ome.tiff"
        info = ome.ImageInfo(r.channel_labels, r.width, r.height, DTYPES[dtype][1], r.description or out.name, f"Image:{r.acq_id}", f"Pixels:{r.acq_id}", f"Channel:{r.acq_id}:", r.ablation_x, r.ablation_y)
        images.append({"path": str(out), "xml": ome.to_xml(info), "channels": r.num_channels, "shape": (r.max_y, r.max_x)})
    places = F.create_map(*(F.lit(x) for k, r in enumerate(rows) for x in (r.roi_id, k)))
    cells = mosaic.region_images(c.records(rows, say), chosen, dtype).withColumn("image", F.element_at(places, F.col("roi_id")))
    write_images(cells, images, dtype, compression)
    say(f"  Processed {path.name}: {len(rows)} ROIs converted")
    return len(rows)


def stitch(input_path, output_path=None, dtype="uint16", compression="zstd", roi_arg=None, out_dir=None, silent=False, container: Container | None = None, selected: DataFrame | None = None) -> int:
    """The whole-slide mosaic of the selected regions as one OME-TIFF; gives the number of regions."""
    _check_options(dtype, compression)
    say = (lambda *a: None) if silent else print
    path = Path(input_path)
    c = container or Container(session(), path)
    if not c.rois.take(1):
        say(f"  No ROIs found in {path.name}")
        return 0
    chosen = selected if selected is not None else catalog.select_rois(c.rois, roi_arg)
    rows = chosen.orderBy("sel_ord").collect()
    if not rows:
        say("  No ROIs selected")
        return 0
    labels = rows[0].channel_labels
    if more := [r.description for r in rows if r.num_channels > rows[0].num_channels]:
        raise ValueError(f"regions with more channels than the first: {more}")
    size = geometry.canvas(chosen).first()
    folder = Path(out_dir) if out_dir else Path(output_path) if output_path else path.parent / "MCD_Stitched"
    out = folder / f"{path.stem}_stitched.ome.tiff"
    info = ome.ImageInfo(labels, size.canvas_w, size.canvas_h, DTYPES[dtype][1], out.name, "Image:Stitched", "Pixels:Stitched", "Channel:Stitched:", size.g, size.g)
    cells = mosaic.mosaic(c.records(rows, say), chosen, dtype).withColumn("image", F.lit(0))
    write_images(cells, [{"path": str(out), "xml": ome.to_xml(info), "channels": len(labels), "shape": (size.canvas_h, size.canvas_w)}], dtype, compression)
    say(f"  Processed {path.name}: {len(rows)} ROIs stitched")
    return len(rows)


def list_channels(path) -> list[str]:
    with open(path, "rb") as f:
        return ome.from_xml(tiff.read_pages(f)[0].description).channels


def subset_file(path, out, spec: str | None, compression: str | None, dtype: str, pyramid: bool = False) -> Path:
    """Selected channels of one image into the file ``out``, plane by plane, with three smaller levels if ``pyramid``.

    A channel is a page, whether the pages are one series or a series each.
    """
    path, out = Path(path), Path(out)
    with open(path, "rb") as f:
        pages = tiff.read_pages(f)
        info = ome.from_xml(pages[0].description)
        wanted = [i for i in parse_channels(spec) if 0 <= i < len(info.channels)] if spec else list(range(len(info.channels)))
        if not wanted:
            raise ValueError(catalog.NO_CHANNELS)
        if out.resolve() == path.resolve():
            raise ValueError(f"the output would replace its input {path}")
        out.parent.mkdir(parents=True, exist_ok=True)
        new = ome.ImageInfo([info.channels[i] for i in wanted], info.size_x, info.size_y, DTYPES[dtype][1], out.name, physical_x=info.physical_x, physical_y=info.physical_y)
        tiff.write_tiff(str(out), (cast_plane(pages[i].asarray(), dtype) for i in wanted), ome.to_xml(new), compression, 4 if pyramid else 1)
    return out


def cast_plane(a: np.ndarray, dtype: str) -> np.ndarray:
    """``scalars.to_output`` for a whole plane."""
    if dtype == "uint16":
        return np.clip(np.nan_to_num(a.astype(np.float64), nan=0.0, posinf=65535, neginf=0), 0, 65535).astype("<u2")
    return a.astype("<f4")


def tiff_subset(input_path=None, output_path=None, output_type="uint16", compression="zstd", filter=None, pyramid=False, list_channels_only=False, out_dir=None, silent=False, tiff_files=None) -> int:
    """Subsets image files, each in a task of its own; a file that fails is logged and the others go on."""
    _check_options(output_type, compression)
    say = (lambda *a: None) if silent else print
    if tiff_files is not None:
        files = [Path(p) for p in tiff_files if Path(p).exists()]
    else:
        files = resolve_tiffs(input_path)
        if list_channels_only:
            if len(files) != 1:
                raise ValueError("listing channels needs exactly one file")
            for line in reports.channel_listing(list_channels(files[0])):
                print(line)
            return 0
    if not files:
        return 0
    # A folder for each input folder, unless one is named.
    jobs = [(str(p), str(out_dir or (Path(output_path) if output_path else p.parent))) for p in files]
    spark = session()
    rows = spark.createDataFrame(jobs, "path string, folder string").withColumn("name", scalars.subset_name(F.col("path"), bool(filter), pyramid)).repartition(min(len(jobs), 10_000))

    def run(batches):
        for b in batches:
            status = []
            for path, folder, name in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    subset_file(path, Path(folder) / name, filter, compression, output_type, pyramid)
                    status.append((None, None))
                except Exception as e:  # one bad file must not end the others
                    status.append((f"{type(e).__name__}: {e}", traceback.format_exc()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s[0] for s in status], pa.string()), pa.array([s[1] for s in status], pa.string())], ["path", "folder", "message", "trace"])

    done = rows.mapInArrow(run, "path string, folder string, message string, trace string").collect()
    failed = [r for r in done if r.message]
    for r in failed:
        say(f"  Error: {r.path}: {r.message}")
        Path(r.folder).mkdir(parents=True, exist_ok=True)
        with open(Path(r.folder) / "error_log.txt", "a", encoding="utf-8") as f:
            f.write(f"{datetime.now(UTC).isoformat()} - {r.path}\n{r.message}\n{r.trace}\n")
    say(f"  {len(done) - len(failed)} of {len(files)} files in {len({p.parent for p in files})} folders")
    return len(done) - len(failed)


def _resolved(c: Container, stem: str, folder: Path) -> DataFrame:
    """Sizes by (slide_ix, pano_ix): from the header of a PNG that is there, else of the decoded image."""
    rows = []
    for (slide, pano), image in c.images.items():
        there = folder / f"{stem}_slide_{slide}_pano_{pano}.png"
        size = png.png_size(there.read_bytes()[:32]) if there.exists() else None
        if size or image is not None:
            rows.append((slide, pano, *(size or image.shape[1::-1])))
    return c.spark.createDataFrame(rows, "slide_ix int, pano_ix int, width_px int, height_px int")


def _panoramas(c: Container, stem: str, spec: str | None, folder: Path, overlays: bool = True) -> list:
    """Rows of the panoramas that a list names and that can be read, written as PNG."""
    decoded = c.panoramas.where("width_px is not null").select("slide_ix", "pano_ix", "width_px", "height_px")
    flat = geometry.panorama_bounds(catalog.select_panoramas(c.panoramas, spec)).drop("width_px", "height_px")
    rows = reports.panorama_plan(flat, decoded, stem).where("status = 'ok'").orderBy("flat_ix").collect()
    regions = catalog.select_rois(c.rois).take(1)
    for p in rows:
        folder.mkdir(parents=True, exist_ok=True)
        image = c.images[p.slide_ix, p.pano_ix]
        (folder / p.path).write_bytes(png.write_png(image))
        if overlays and regions and p.overlay:
            if p.box_status != "ok":
                raise ValueError(f"panorama {p.flat_ix}: slide corners are {p.box_status}")
            drawn, base = _overlay_rows(c, p), folder / Path(p.path).stem
            Path(f"{base}_overlay.png").write_bytes(png.write_png(png.draw_overlay(image, drawn)))
            Path(f"{base}_overlay_labels.json").write_text(json.dumps([{k: d[k] for k in ("name", "centre", "colour", "font_size")} for d in drawn]), encoding="utf-8")
    return rows


def _overlay_rows(c: Container, p) -> list[dict]:
    one = c.spark.createDataFrame([(p.width_px, p.height_px, p.p_min_x, p.p_max_x, p.p_min_y, p.p_max_y)], "width_px int, height_px int, p_min_x double, p_max_x double, p_min_y double, p_max_y double")
    regions = geometry.in_panorama(catalog.select_rois(c.rois).drop("width", "height"), one)
    g = geometry.overlay_geometry(regions).withColumn("name", scalars.overlay_name(F.col("description"), F.col("roi_ix"))).orderBy("roi_ix").collect()
    return [{"points": [(q.x, q.y) for q in r.points], "colour": r.colour, "line_width": r.line_width, "font_size": r.font_size, "centre": (r.centre_x, r.centre_y), "name": r.name} for r in g]


def process(input_path, output_path=None, convert_rois=False, stitch_rois=False, panorama=None, metadata=False, roi_map=None, filter=None, pyramid=False, roi=None, output_type="uint16", compression="zstd") -> None:
    """All operations over one container or a folder of them, in a fixed order; each container is opened once."""
    if not (convert_rois or stitch_rois or panorama is not None or metadata):
        raise ValueError("no operation: choose convert, stitch, panorama or metadata")
    if (filter or pyramid) and not (convert_rois or stitch_rois):
        raise ValueError("filter and pyramid need convert or stitch")
    _check_options(output_type, compression)
    files = resolve_inputs(input_path)
    all_began = time.time()
    print(f"Containers: {len(files)}")

    def timed(what: str, run) -> None:
        began = time.time()
        print(f"  {what} ...", end=" ", flush=True)
        run()
        print(f"{time.time() - began:.1f} s")

    for path in files:
        began = time.time()
        folder = Path(output_path) / path.stem if output_path else path.parent / "MCD_Processed" / path.stem
        try:
            c = Container(session(), path)
            empty = not c.rois.take(1)
        except Exception as e:
            print(f"  {path.name}: skipped, {e}")
            continue
        if empty:
            print(f"  No ROIs found in {path.name}")
            continue
        chosen = catalog.select_rois(c.rois, roi)
        rows = chosen.orderBy("sel_ord").collect()
        print(f"  {path.name}: {len(rows)} of {c.rois.count()} regions")
        if metadata:
            labels = c.rois.where("roi_ix = 0").first().channel_labels
            print(reports.text_of(reports.summary_lines(path.stem, chosen, labels, c.panoramas)))
        if panorama is not None:
            timed("panoramas", lambda: _panoramas(c, path.stem, panorama, folder))
        if roi_map is not None:
            write_roi_maps(c, path.stem, chosen, folder, roi_map, stitch_rois, convert_rois)
        produced = []
        if convert_rois:
            timed(f"converting {len(rows)} regions", lambda: convert(path, dtype=output_type, compression=compression, out_dir=folder, silent=True, container=c, rois=chosen))
            produced += [folder / f"{r.description}.ome.tiff" for r in rows]
        if stitch_rois:
            timed(f"stitching {len(rows)} regions", lambda: stitch(path, dtype=output_type, compression=compression, out_dir=folder, silent=True, container=c, selected=chosen))
            produced.append(folder / f"{path.stem}_stitched.ome.tiff")
        if filter or pyramid:
            timed(f"subsets of {len(produced)} images", lambda: tiff_subset(output_type=output_type, compression=compression, filter=filter, pyramid=pyramid, out_dir=folder, silent=True, tiff_files=produced))
        print(f"  {path.name}: {time.time() - began:.1f} s")
    print(f"All containers: {time.time() - all_began:.1f} s")


def write_roi_maps(c: Container, stem: str, chosen: DataFrame, folder: Path, spec: str, stitched: bool, converted: bool) -> list[Path]:
    """Map files of the panoramas that a list names ("all": the first)."""
    wanted = parse_indices(spec)
    flat = geometry.panorama_bounds(c.panoramas).where(F.col("flat_ix").isin([0] if wanted is None else wanted)).drop("width_px", "height_px")
    plan = geometry.local(reports.panorama_plan(flat, _resolved(c, stem, folder), stem))
    lines = reports.roi_map_lines(plan.where("status = 'ok' and box_status = 'ok'"), chosen, reports.map_canvas(chosen) if stitched else None, converted or not stitched)
    out = []
    for p in plan.orderBy("flat_ix").collect():
        if p.status != "ok" or p.box_status != "ok":
            print(f"  WARNING: Could not read panorama {p.flat_ix}")
            continue
        folder.mkdir(parents=True, exist_ok=True)
        out.append(folder / p.path.replace(".png", "_roi_map.txt"))
        out[-1].write_text(reports.text_of(lines.where(F.col("flat_ix") == p.flat_ix)), encoding="utf-8")
    return out
