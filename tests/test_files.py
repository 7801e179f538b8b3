"""Files: segments, TIFF, PNG, OME-XML, and the entry points over a generated container."""

import base64
import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom import api, cli
from pixelloom.functions import scalars
from pixelloom.functions.indexspec import parse_channels, parse_indices
from pixelloom.operators import mosaic
from pixelloom.sources import ome, png, segments, tiff


@pytest.mark.parametrize("data", [b"", b"a", b"abcabcabc" * 50, bytes(range(256)) * 40, bytes(100_000), np.random.default_rng(0).bytes(60_000)])
def test_lzw(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("compression", ["zstd", "LZW", None])
@pytest.mark.parametrize("tile", [256, None])
def test_tiff(tmp_path, compression, tile):
    rng = np.random.default_rng(1)
    planes = [rng.integers(0, 65535, (300, 270)).astype("<u2"), np.zeros((300, 270), "<u2")]
    path = tmp_path / "a.ome.tiff"
    tiff.write_tiff(str(path), planes, "é <xml/>", compression, levels=4, tile=tile)
    pages = tiff.read_pages(io.BytesIO(path.read_bytes()))
    assert [p.description for p in pages] == ["é <xml/>", None] and not list(tmp_path.glob("*part*"))
    for page, plane in zip(pages, planes, strict=True):
        assert (page.asarray() == plane).all() and len(page.subs) == 3
        for k, sub in enumerate(page.subs, 1):
            assert (sub.asarray() == plane[:: 2**k, :: 2**k]).all() and sub.tags[tiff.NEW_SUBFILE] == [1]
    with pytest.raises(ValueError, match="compression"):
        tiff.compression_name("jpeg")


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_classic_tiff(order, predictor):
    """Two pages of different sizes, in strips, one deflated with horizontal differences: as a series a channel has them."""
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 60_000, (5, 7)).astype(f"{order}u2"), rng.integers(0, 60_000, (3, 2)).astype(f"{order}u2")]
    data, link, entry = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0)), 4, f"{order}HHI4s"
    for k, a in enumerate(images):
        strips = []
        for y in range(0, a.shape[0], 2):
            part = a[y : y + 2]
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part.dtype.type(0)).astype(a.dtype)
            strips.append(zlib.compress(part.tobytes()) if k == 0 else part.tobytes())
        at = []
        for x in strips:
            at.append(len(data))
            data += x
        tables = []
        for values in (at, [len(x) for x in strips]):
            tables.append(len(data))
            data += struct.pack(f"{order}{len(values)}I", *values)
        one = lambda v: struct.pack(f"{order}I", v)
        short = lambda v: struct.pack(f"{order}HH", v, 0)
        many = [at[0], len(strips[0])] if len(strips) == 1 else tables
        tags = [(256, 4, 1, one(a.shape[1])), (257, 3, 1, short(a.shape[0])), (258, 3, 1, short(16)), (259, 3, 1, short(8 if k == 0 else 1)), (273, 4, len(at), one(many[0])), (278, 4, 1, one(2)), (279, 4, len(at), one(many[1])), (317, 3, 1, short(predictor))]
        data[link : link + 4] = one(len(data))
        data += struct.pack(f"{order}H", len(tags)) + b"".join(struct.pack(entry, *t) for t in tags)
        link = len(data)
        data += one(0)
    pages = tiff.read_pages(io.BytesIO(bytes(data)))
    assert len(pages) == 2 and all((p.asarray() == a).all() for p, a in zip(pages, images, strict=True))
    with pytest.raises(ValueError, match="no TIFF"):
        tiff.read_pages(io.BytesIO(b"GIF89a"))


def test_png_filters_and_palette():
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (6, 9, 3)).astype(np.uint8)
    rows, above = b"", np.zeros(27, int)
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        own = image[y].ravel().astype(int)
        left = np.concatenate([np.zeros(3, int), own[:-3]])
        corner = np.concatenate([np.zeros(3, int), above[:-3]])
        near = [min((abs(u - c), 0, a), (abs(a - c), 1, u), (abs(a + u - 2 * c), 2, c))[2] for a, u, c in zip(left, above, corner, strict=True)]
        guess = [np.zeros(27, int), left, above, (left + above) // 2, np.array(near)][kind]
        rows += bytes([kind]) + ((own - guess) % 256).astype(np.uint8).tobytes()
        above = own
    head = lambda w, h, c: png._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, c, 0, 0, 0))
    body = zlib.compress(rows)
    data = png.SIGNATURE + head(9, 6, 2) + png._chunk(b"IDAT", body[:40]) + png._chunk(b"IDAT", body[40:]) + png._chunk(b"IEND", b"")
    assert (png.read_png(data) == image).all()
    colours = rng.integers(0, 256, (4, 3)).astype(np.uint8)
    data = png.SIGNATURE + head(2, 1, 3) + png._chunk(b"PLTE", colours.tobytes()) + png._chunk(b"IDAT", zlib.compress(b"\0\3\1"))
    assert (png.read_png(data) == colours[[3, 1]][None]).all()
    two = rng.integers(0, 256, (3, 4, 2)).astype(np.uint8)
    assert (png.read_png(png.write_png(two)) == two).all()


def test_planes_are_cast_as_columns_are(spark):
    v = [-3.0, 0.7, 1.99, 65535.0, 70000.0, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for dtype in ("uint16", "float32"):
        want = [r[0] for r in df.select(scalars.to_output(F.col("v"), dtype)).collect()]
        np.testing.assert_array_equal(api.cast_plane(np.array(v), dtype), np.array(want, np.float32 if dtype == "float32" else np.uint16))
    plane = np.arange(35).reshape(5, 7)
    cells = spark.createDataFrame([(y, x, int(plane[y, x])) for y in range(5) for x in range(7)], "y int, x int, v int")
    for level, a in enumerate(tiff.strided_levels(plane, 3)):
        got = {(r.y, r.x): r.v for r in mosaic.pyramid(cells, 3).where(f"level = {level}").collect()}
        assert got == {(y, x): a[y, x] for y in range(a.shape[0]) for x in range(a.shape[1])}


def test_planes_are_written_by_many_tasks(spark, tmp_path):
    images = [{"path": str(tmp_path / f"{k}.tiff"), "xml": ome.to_xml(ome.ImageInfo(["a", "b", "c"], 300, 260)), "channels": 3, "shape": (260, 300)} for k in range(2)]
    rng = np.random.default_rng(9)
    rows = [(int(k), int(c), int(y), int(x), float(v)) for k, c, y, x, v in zip(rng.integers(0, 2, 400), rng.choice([0, 2], 400), rng.integers(0, 260, 400), rng.integers(0, 300, 400), rng.integers(1, 9, 400), strict=True)]
    rows = [(*k, v) for k, v in {r[:4]: r[4] for r in rows}.items()]
    cells = spark.createDataFrame(rows, "image int, ch int, y int, x int, v double").repartition(5)
    assert api.write_images(cells, images, "uint16", "zstd", levels=2) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.tiff", "1.tiff"]
    for k, i in enumerate(images):
        want = np.zeros((3, 260, 300), np.uint16)
        for im, c, y, x, v in rows:
            if im == k:
                want[c, y, x] = v
        with open(i["path"], "rb") as f:
            pages = tiff.read_pages(f)
            assert (np.stack([p.asarray() for p in pages]) == want).all() and (pages[2].subs[0].asarray() == want[2, ::2, ::2]).all()


def test_png():
    image = np.random.default_rng(2).integers(0, 255, (7, 5, 3)).astype(np.uint8)
    data = png.write_png(image)
    assert png.png_size(data) == (5, 7) and (png.read_png(data) == image).all() and png.png_size(b"x") is None
    drawn = png.draw_overlay(np.zeros((60, 60, 1), np.uint8), [{"points": [(5, 5), (50, 5), (50, 50)], "colour": "#ff0000", "line_width": 2, "font_size": 10, "centre": (30, 30), "name": "R"}])
    assert drawn[5, 20].tolist() == [255, 0, 0] and drawn[30, 30].tolist() == [255, 0, 0] and drawn[55, 5].tolist() == [0, 0, 0]


def test_ome():
    info = ome.from_xml(ome.to_xml(ome.ImageInfo(["a<b", "c"], 3, 4, "float", "n", physical_x=0.5)))
    assert (info.channels, info.size_x, info.size_y, info.physical_x, info.physical_y) == (["a<b", "c"], 3, 4, 0.5, 1.0)
    with pytest.raises(ValueError, match="No OME-XML"):
        ome.from_xml(None)


def test_index_specs():
    cases = {"": [], ",": [], "0,2,5": [0, 2, 5], "1-5": [1, 2, 3, 4, 5], "3,5-6,2": [3, 5, 6, 2], "5-3": [], " 1 - 3 ": [1, 2, 3], "2,1-3": [2, 1, 3]}
    assert all(parse_indices(s) == want for s, want in cases.items()) and parse_indices("all") is None
    assert parse_channels("3,1-2,1") == [1, 2, 3] and parse_channels("all") == []
    with pytest.raises(ValueError, match="Invalid index 9"):
        parse_indices("1,9", 5)
    with pytest.raises(ValueError):
        parse_indices("-1")


def segment(xs, ys, values, width):
    rows = np.concatenate([np.array(xs)[:, None], np.array(ys)[:, None], np.zeros((len(xs), 1)), np.array(values)], axis=1)
    return rows.astype({2: "<f2", 4: "<f4", 8: "<f8"}[width]).tobytes()


@pytest.mark.parametrize("width", [2, 4, 8])
def test_segments(spark, tmp_path, width):
    raw = segment(range(7), range(7), [[i, 2 * i] for i in range(7)], width)
    path = tmp_path / "x.mcd"
    path.write_bytes(b"head" + raw + b"tail!")
    s = {"roi_id": 3, "data_start": 4, "data_end": 4 + len(raw), "value_bytes": width, "num_channels": 2, "name": "r"}
    rows = segments.read_segments(spark, str(path), [s], strict=True).where("roi_id = 3").orderBy("rec_ord").collect()
    assert [(r.x, r.y, r["values"]) for r in rows] == [(i, i, [i, 2 * i]) for i in range(7)]
    assert segments.read_segments(spark, str(path), [s]).where("roi_id = 4").count() == 0
    partial = s | {"data_end": s["data_end"] + 3}
    df, warnings = segments.read_segments_safely(spark, str(path), [partial])
    assert df.count() == 7 and len(warnings) == 1
    assert segments.read_segments(spark, str(path), [s | {"data_end": 10**6}]).count() >= 7
    with pytest.raises(segments.SegmentError, match="mismatch"):
        segments.count_records(partial, True)
    with pytest.raises(segments.SegmentError, match="ValueBytes=3"):
        segments.count_records(s | {"value_bytes": 3}, False)


def test_long_segment(spark, tmp_path, monkeypatch):
    n = 50_001
    path = tmp_path / "long.mcd"
    path.write_bytes(segment(np.arange(n) % 100, np.arange(n) // 100, np.ones((n, 1)), 4))
    s = {"roi_id": 0, "data_start": 0, "data_end": n * 16, "num_channels": 1}
    df = segments.read_segments(spark, str(path), [s])
    assert df.selectExpr("count(*)", "count(distinct rec_ord)", "max(rec_ord)").first() == (n, n, n - 1)


class Model:
    """Dense regions and their mosaic, straight from the formulas."""

    def __init__(self, rois):
        self.rois = rois

    def cube(self, r, dtype):
        img = np.zeros((len(r["labels"]), r["h"], r["w"]))
        for x, y, v in zip(r["xs"], r["ys"], r["values"], strict=True):
            x, y = int(x), int(y)
            if 0 <= x < r["w"] and 0 <= y < r["h"]:
                img[:, y, x] = v
        return self.cast(img, dtype)

    @staticmethod
    def cast(img, dtype):
        return np.clip(np.nan_to_num(img, nan=0, posinf=1e9), 0, 65535).astype("<u2") if dtype == "uint16" else img.astype("<f4")

    def mosaic(self, dtype, order):
        rois = [self.rois[i] for i in order]
        xs, ys = [x for r in rois for x, _ in r["corners"]], [y for r in rois for _, y in r["corners"]]
        g = min(r["px"] for r in rois)
        width, height = int(np.ceil((max(xs) - min(xs)) / g)), int(np.ceil((max(ys) - min(ys)) / g))
        out = np.zeros((len(rois[0]["labels"]), height, width), "<u2" if dtype == "uint16" else "<f4")
        for r in rois:
            c = self.cube(r, dtype)
            mx, my = min(x for x, _ in r["corners"]) - min(xs), min(y for _, y in r["corners"]) - min(ys)
            x0, y0 = round(mx / g), height - round(my / g) - r["h"]
            poly = [((x - min(xs) - mx) / g, (y - min(ys) - my) / g) for x, y in r["corners"]]
            for i in range(min(height, y0 + r["h"]) - max(0, y0)):
                for j in range(min(width, x0 + r["w"]) - max(0, x0)):
                    inside = False
                    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1], strict=True):
                        inside ^= (ay > i) != (by > i) and j < ax + (bx - ax) * (i - ay) / (by - ay)
                    for k in range(len(c)):
                        if inside and c[k, i, j] > 0:
                            out[k, max(0, y0) + i, max(0, x0) + j] = c[k, i, j]
        return out


@pytest.fixture()
def container(tmp_path):
    rng = np.random.default_rng(7)
    rois, acqs, raw = [], [], b"MCD"
    shapes = [[(0, 0), (12, 0), (12, 9), (0, 9)], [(8, 4), (20, 4), (20, 13), (8, 13)], [(3, 6), (17, 6), (10, 15)]]
    for k, corners in enumerate(shapes):
        w, h = (12, 9) if k < 2 else (14, 9)
        n = 150
        xs, ys = rng.integers(-2, w + 2, n), rng.integers(-1, h + 1, n)
        values = rng.choice([-3.0, 0.0, 0.7, 1.99, 40.0, 65535.0, 70000.0], (n, 2))
        data = segment(xs, ys, values, 4)
        rois.append({"corners": corners, "w": w, "h": h, "px": 1.0, "labels": ["A", "B"], "xs": xs, "ys": ys, "values": np.array(values, np.float32)})
        acqs.append({
            "id": k, "description": f"roi{k}", "roi_points_um": corners, "pixel_size_x_um": 1.0, "pixel_size_y_um": 1.0, "width_px": w, "height_px": h, "channel_labels": ["A", "B"],
            "metadata": {"StartTimeStamp": f"2024-01-0{k + 1}T10:00:00.1234567+02:00", "DataStartOffset": len(raw), "DataEndOffset": len(raw) + len(data) + (k == 1), "ValueBytes": 4, "MaxX": w, "MaxY": h},
        })
        raw += data
    acqs.append(acqs[0] | {"id": 9, "roi_points_um": []})
    pano = {"metadata": {f"Slide{a}{i}PosUm": v for i, xy in enumerate([(0, 20), (40, 20), (40, 0), (0, 0)], 1) for a, v in zip("XY", xy, strict=True)} | {"Description": "p"}, "image_png": base64.b64encode(png.write_png(np.full((20, 40, 3), 9, np.uint8))).decode()}
    path = tmp_path / "slide.mcd"
    path.write_bytes(raw + b"\0" * 8)
    path.with_suffix(".json").write_text(json.dumps({"slides": [{"acquisitions": acqs, "panoramas": [pano, pano | {"metadata": {}, "image_png": None}]}]}))
    return path, Model(rois)


def planes(path):
    with open(path, "rb") as f:
        pages = tiff.read_pages(f)
        return np.stack([p.asarray() for p in pages]), ome.from_xml(pages[0].description)


def test_convert_and_stitch(spark, container, tmp_path, capsys):
    path, model = container
    assert api.convert(path, tmp_path / "out") == 3
    assert "Retrying in recovery mode" in capsys.readouterr().out
    for k in range(3):
        got, info = planes(tmp_path / f"out/slide/roi{k}.ome.tiff")
        assert (got == model.cube(model.rois[k], "uint16")).all() and info.channels == ["A", "B"]
    for dtype, spec, order in (("uint16", None, [2, 1, 0]), ("float32", "all", [2, 1, 0]), ("uint16", "2,0", [0, 2])):
        assert api.stitch(path, tmp_path / "st", dtype, "LZW", spec, silent=True) == len(order)
        got, _ = planes(tmp_path / "st/slide_stitched.ome.tiff")
        assert (got == model.mosaic(dtype, order)).all()
    with pytest.raises(ValueError, match="Invalid index"):
        api.stitch(path, roi_arg="7")
    with pytest.raises(ValueError, match="empty"):
        api.stitch(path, roi_arg=",")
    with pytest.raises(ValueError, match="output type"):
        api.convert(path, dtype="int8")


def test_process_and_subset(spark, container, tmp_path, capsys):
    path, model = container
    api.process(path, tmp_path / "p", convert_rois=True, stitch_rois=True, panorama="all", metadata=True, roi_map="0", filter="1", pyramid=True)
    text = capsys.readouterr().out
    assert "ROI TABLE" in text and "CHANNELS (2): A, B" in text and "2024-01-03 10:00:00" in text
    folder = tmp_path / "p/slide"
    assert png.png_size((folder / "slide_slide_0_pano_0.png").read_bytes()) == (40, 20)
    table = (folder / "slide_slide_0_pano_0_roi_map.txt").read_text()
    assert "stitched_canvas_pixels: 20 x 15" in table and table.index("roi0") < table.index("roi2")
    assert "    top_left: 0.0, 20.0" in table
    got, info = planes(folder / "roi1_filtered_pyramid.ome.tiff")
    assert info.channels == ["B"] and (got[0] == model.cube(model.rois[1], "uint16")[1]).all()
    assert (folder / "slide_stitched_filtered_pyramid.ome.tiff").exists()
    with pytest.raises(ValueError, match="no operation"):
        api.process(path)
    (folder / "bad.tiff").write_bytes(b"nothing")
    assert api.tiff_subset(folder, tmp_path / "s", filter="0,7", silent=True) == len(list(folder.glob("*.tiff"))) - 1
    assert "bad.tiff" in (tmp_path / "s/error_log.txt").read_text()
    assert api.tiff_subset(tiff_files=[folder / "gone.tiff"]) == 0
    with pytest.raises(ValueError, match="replace"):
        api.subset_file(folder / "roi0.ome.tiff", folder / "roi0.ome.tiff", None, None, "uint16")
    with pytest.raises(ValueError, match="No valid channels"):
        api.subset_file(folder / "roi0.ome.tiff", tmp_path / "x.ome.tiff", "all", None, "uint16")


def test_process_skips_what_it_cannot_open(spark, container, tmp_path, capsys):
    path, model = container
    folder = tmp_path / "many"
    folder.mkdir()
    for name in ("good", "empty", "bare", "broken"):
        (folder / f"{name}.mcd").write_bytes(path.read_bytes())
    raw = json.loads(path.with_suffix(".json").read_text())
    (folder / "good.json").write_text(json.dumps(raw))
    (folder / "empty.json").write_text(json.dumps({"slides": []}))
    (folder / "broken.json").write_text("{")
    api.process(folder, tmp_path / "out", stitch_rois=True, roi_map="0,1", panorama="0")
    text = capsys.readouterr().out
    assert "bare.mcd: skipped" in text and "broken.mcd: skipped" in text and "No ROIs found in empty.mcd" in text and "Containers: 4" in text
    assert "stitching 3 regions ..." in text and "All containers:" in text and "Could not read panorama 1" in text
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.tiff")) == ["good_stitched.ome.tiff"]
    got, _ = planes(tmp_path / "out/good/good_stitched.ome.tiff")
    assert (got == model.mosaic("uint16", [2, 1, 0])).all()
    # A picture that is there already tells a panorama's size.
    (tmp_path / "out/good/good_slide_0_pano_0.png").write_bytes(png.write_png(np.zeros((10, 80, 1), np.uint8)))
    api.process(folder / "good.mcd", tmp_path / "out", stitch_rois=True, roi_map="all")
    assert "panorama_pixels: 80 x 10" in (tmp_path / "out/good/good_slide_0_pano_0_roi_map.txt").read_text()


def test_command_lines(spark, container, tmp_path, capsys):
    path, _ = container
    assert cli.main(["stitch", "-r", "0,1", str(path), str(tmp_path / "c")]) == 0 and (tmp_path / "c/slide_stitched.ome.tiff").exists()
    assert cli.main(["process", str(path)]) == 1
    assert cli.main(["subset", "-l", str(tmp_path / "c/slide_stitched.ome.tiff")]) == 0
    assert "0: A\n1: B" in capsys.readouterr().out
    for bad in (["stitch", str(tmp_path)], ["convert", str(tmp_path / "slide.json")], ["process", "-x", "-r", "0", str(tmp_path)], ["process", "-m", "-R", "0", "--", str(path)], ["process", "-m", "-f", "0", str(path)], ["subset", str(tmp_path)], ["subset", "-l", "-p", str(tmp_path)], ["stitch", "-c", "ZSTD", str(path)]):
        with pytest.raises(SystemExit):
            cli.main(bad)
