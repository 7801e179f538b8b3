"""Operators on hand-made edge cases, and a few invariants."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom.functions import scalars
from pixelloom.operators import catalog, geometry, mosaic, reports

ROI = "file_id string, roi_id int, catalog_ord int, slide_ix int, description string, start_ts int, corners array<struct<x:double,y:double>>, px_x double, px_y double, width int, height int, max_x int, max_y int"


def roi(i, x, y, w, h, start=None, px=1.0, py=None, corners=None):
    c = corners or [(x, y), (x + w * px, y), (x + w * px, y + h * (py or px)), (x, y + h * (py or px))]
    return ("f", i, i, 0, f"r{i}", start, [(float(a), float(b)) for a, b in c], px, py or px, w, h, w, h)


def rois(spark, *rows):
    return catalog.load_rois(spark.createDataFrame(list(rows), ROI))


def records(spark, rows):
    return spark.createDataFrame([(r, 0, float(x), float(y), float(v), o) for o, (r, x, y, v) in enumerate(rows)], "roi_id int, ch int, x double, y double, v double, rec_ord long")


def values(df):
    return {(r.y, r.x): r.v for r in df.collect()}


def test_order_of_regions(spark):
    made = rois(spark, roi(0, 0, 0, 1, 1, 5), roi(1, 0, 0, 1, 1, 9), roi(2, 0, 0, 1, 1, None), roi(3, 0, 0, 1, 1, 5), ("f", 4, 4, 0, None, 1, [], 1.0, 1.0, 1, 1, 1, 1), ("f", 5, 5, 0, None, 1, None, 1.0, 1.0, 1, 1, 1, 1))
    assert [r.roi_id for r in made.orderBy("roi_ix").collect()] == [1, 0, 3, 2]
    assert [(r.roi_id, r.sel_ord) for r in catalog.select_rois(made, "2,0").orderBy("sel_ord").collect()] == [(3, 0), (1, 1)]
    assert catalog.select_rois(made, "all").count() == 4
    for bad in ("4", ",", "5-3"):
        with pytest.raises(ValueError):
            catalog.select_rois(made, bad)
    assert catalog.first_roi(catalog.select_rois(made, "3,1")).first().roi_id == 2


def test_oldest_wins_where_regions_overlap(spark):
    made = rois(spark, roi(0, 0, 0, 4, 1, 1), roi(1, 2, 0, 4, 1, 2))
    rec = records(spark, [(0, x, 0, 10 + x) for x in range(3)] + [(0, 3, 0, 0)] + [(1, x, 0, 20 + x) for x in range(4)])
    assert values(mosaic.mosaic(rec, catalog.select_rois(made))) == {(0, 0): 10, (0, 1): 11, (0, 2): 12, (0, 3): 21, (0, 4): 22, (0, 5): 23}
    assert values(mosaic.mosaic(rec, catalog.select_rois(made, "1,0")))[0, 2] == 20


def test_last_record_wins_even_if_zero(spark):
    made = rois(spark, roi(0, 0, 0, 3, 2))
    rec = records(spark, [(0, 1, 1, 5), (0, 1, 1, 0), (0, -0.9, 0, 7), (0, -1, 0, 8), (0, 3, 0, 9), (0, 2.9, 1.9, 0.7)])
    assert values(mosaic.region_images(rec, made)) == {(1, 1): 0, (0, 0): 7, (1, 2): 0}
    assert values(mosaic.mosaic(rec, catalog.select_rois(made))) == {(0, 0): 7}
    f32 = values(mosaic.mosaic(rec, catalog.select_rois(made), "float32"))
    assert set(f32) == {(0, 0), (1, 2)} and abs(f32[1, 2] - 0.7) < 1e-6
    with pytest.raises(ValueError, match="dtype"):
        mosaic.mosaic(rec, made, "int8")


def test_cast(spark):
    cases = [(-3.0, 0), (0.0, 0), (0.7, 0), (1.99, 1), (65535.0, 65535), (70000.0, 65535), (math.nan, 0), (math.inf, 65535), (-math.inf, 0), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "v double")
    assert [r[0] for r in df.select(scalars.to_uint16(F.col("v"))).collect()] == [b for _, b in cases]
    assert [r[0] for r in df.select(scalars.positive(F.col("v"))).collect()] == [False, False, True, True, True, True, False, True, False, None]


def test_placement(spark):
    made = rois(spark, *(roi(i, x, 0, 2, 2) for i, x in enumerate((0, 0.5, 1.5, 2.5))), roi(4, 0, 0, 2, 9, corners=[(0, 0), (2, 0), (2, 4), (0, 4)]), roi(5, 0, 30, 2, 2))
    p = {r.roi_id: r for r in geometry.place(made, geometry.canvas(made)).collect()}
    assert [p[i].x0 for i in range(4)] == [0, 0, 2, 2] and p[0].canvas_h == 32
    assert (p[4].y0, p[4].top, p[4].bottom) == (23, 23, 32) and p[5].top == 0
    tall = rois(spark, roi(0, 0, 0, 1, 9, corners=[(0, 0), (1, 0), (1, 4), (0, 4)]))
    q = geometry.place(tall, geometry.canvas(tall)).first()
    assert (q.y0, q.top, q.bottom) == (-5, 0, 4)
    # Leading rows stay and move to the edge.
    rec = records(spark, [(0, 0, y, 1 + y) for y in range(9)])
    assert values(mosaic.mosaic(rec, catalog.select_rois(tall))) == {(y, 0): 1 + y for y in range(4)}


def test_mask_is_not_flipped(spark):
    made = rois(spark, roi(0, 0, 0, 4, 4, corners=[(0, 0), (4, 0), (0, 4)]))
    rec = records(spark, [(0, x, y, 1) for x in range(4) for y in range(4)])
    assert set(values(mosaic.mosaic(rec, catalog.select_rois(made)))) == {(y, x) for x in range(4) for y in range(4) if x + y < 4}


@pytest.mark.parametrize("polygon", [[(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)], [(0, 0), (5, 1), (3, 6)], [(1, 1), (4, 1), (4, 3), (1, 3)]])
def test_polygon(spark, polygon):
    pts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in polygon))
    grid = spark.range(64).select((F.col("id") % 8).cast("double").alias("x"), F.expr("cast(id div 8 as double)").alias("y"), pts.alias("polygon"))
    grid = geometry.with_mask(grid)
    got = {(r.x, r.y) for r in grid.where(geometry.in_polygon(F.col("x"), F.col("y"))).collect()}

    def inside(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
            odd ^= (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay)
        return odd

    assert got == {(float(x), float(y)) for x in range(8) for y in range(8) if inside(x, y)}


def test_pitch(spark):
    mixed = rois(spark, roi(0, 0, 0, 4, 4, px=1.0, py=2.0), roi(1, 0, 0, 4, 4, px=1.000001))
    c = geometry.canvas(mixed).first()
    assert (c.g, c.g_x) == (1.0, 1.0)
    p = {r.roi_id: r for r in geometry.place(mixed, geometry.canvas(mixed)).collect()}
    assert (p[0].h_new, p[0].w_new, p[0].same_pitch) == (8, 4, False) and (p[1].h_new, p[1].same_pitch) == (4, True)


def test_resample_keeps_constants(spark):
    made = rois(spark, roi(0, 0, 0, 3, 2, px=2.0), roi(1, 100, 0, 1, 1))
    placed = geometry.place(catalog.select_rois(made), geometry.canvas(made))
    cells = spark.createDataFrame([(0, 0, y, x, 5.0) for y in range(2) for x in range(3)], "roi_id int, ch int, y int, x int, v double")
    got = values(mosaic.resample(cells, placed))
    assert set(got) == {(y, x) for y in range(4) for x in range(6)} and all(abs(v - 5) < 1e-9 for v in got.values())


def test_resample_mirrors_at_the_edges(spark):
    # 1 x 3 to 1 x 6: target centres lie at -0.25, 0.25, 0.75, 1.25, 1.75 and 2.25; what is beyond 0 is 1, beyond 2 is 1.
    made = rois(spark, roi(0, 0, 0, 3, 1, px=2.0, py=1.0), roi(1, 100, 0, 1, 1))
    placed = geometry.place(catalog.select_rois(made), geometry.canvas(made))
    cells = spark.createDataFrame([(0, 0, 0, x, v) for x, v in enumerate((8.0, 40.0, 100.0))] + [(1, 0, 0, 0, 3.0)], "roi_id int, ch int, y int, x int, v double")
    got = mosaic.resample(cells, placed).collect()
    assert {r.x: r.v for r in got if r.roi_id == 0} == {0: 0.75 * 8 + 0.25 * 40, 1: 0.75 * 8 + 0.25 * 40, 2: 0.25 * 8 + 0.75 * 40, 3: 0.75 * 40 + 0.25 * 100, 4: 0.25 * 40 + 0.75 * 100, 5: 0.75 * 100 + 0.25 * 40}
    assert [(r.y, r.x, r.v) for r in got if r.roi_id == 1] == [(0, 0, 3.0)]


def test_coordinates_that_no_integer_holds(spark):
    made = rois(spark, roi(0, 0, 0, 3, 3))
    rec = records(spark, [(0, math.nan, 1, 5), (0, math.inf, 1, 5), (0, -math.inf, 1, 5), (0, 1e300, 1, 5), (0, 1, -1e12, 5), (0, 1, math.nan, 5), (0, 2.9, 0, 6), (0, -0.5, 1, 7)])
    assert values(mosaic.region_images(rec, made)) == {(0, 2): 6, (1, 0): 7}
    assert values(mosaic.mosaic(rec, catalog.select_rois(made))) == {(0, 2): 6, (1, 0): 7}


def test_pyramid_sizes(spark):
    cells = spark.createDataFrame([(0, y, x, y * 6 + x) for y in range(5) for x in range(6)], "ch int, y int, x int, v int")
    got = {}
    for r in mosaic.pyramid(cells).collect():
        got.setdefault(r.level, {})[r.y, r.x] = r.v
    assert [len(got[k]) for k in range(4)] == [30, 9, 4, 1] and got[1][2, 2] == 28
    twice = mosaic.pyramid(mosaic.pyramid(cells, 3).where("level = 1").drop("level"), 3).where("level = 1")
    assert values(twice) == got[2]


def test_channels(spark):
    cells = spark.createDataFrame([(c, 0, 0, c) for c in range(6)], "ch int, y int, x int, v int")
    assert {(r.new_ch, r.v) for r in catalog.select_channels(cells, [4, 1, 4]).collect()} == {(0, 1), (1, 4)}
    with pytest.raises(ValueError, match="No valid channels"):
        catalog.select_channels(cells, [])


def test_segments_and_panoramas(spark):
    seg = spark.createDataFrame([(0, 0, 40, 4, 2), (1, 0, 43, 4, 2), (2, 0, 40, 3, 2)], "i int, data_start long, data_end long, value_bytes int, num_channels int")
    assert [(r.n_records, r.status) for r in mosaic.segment_check(seg).orderBy("i").collect()] == [(2, "ok"), (0, "partial"), (0, "unsupported")]
    assert [r.n_records for r in mosaic.segment_check(seg, False).orderBy("i").collect()] == [2, 2, 0]
    odd = seg.withColumn("file_size", F.when(F.col("i") == 0, 25).otherwise(1000).cast("long"))
    assert [(r.n_records, r.status, r.data_end) for r in mosaic.isolate(odd).orderBy("i").collect()] == [(1, "recovered", 40), (2, "recovered", 43), (0, "skipped", 40)]
    panorama = spark.createDataFrame([(0, 10, 20, 0.0, 1.0, 0.0, 2.0)], "flat_ix int, width_px int, height_px int, p_min_x double, p_max_x double, p_min_y double, p_max_y double")
    made = catalog.select_rois(rois(spark, roi(0, 0, 0, 1, 1), roi(1, 0.0625, 0, 1, 1, corners=[(0.00625, 0), (1, 0)])))
    text = reports.text_of(reports.roi_map_lines(panorama, made))
    # The last of the regions comes first; ties go to the even digit.
    assert text.index("--- r1 ---") < text.index("--- r0 ---") and "top_left: 0.0, 20.0" in text and "top_left: 0.1, 20.0" in text
    assert [r[0] for r in spark.createDataFrame([(0.0625,), (0.1875,), (1234.5,), (-0.25,)], "x double").select(reports.fixed(F.col("x"), 3)).collect()] == ["0.062", "0.188", "1234.500", "-0.250"]


def test_names(spark):
    df = spark.createDataFrame([("a/b/x.ome.y.ome.tiff", None, 0), ("c.tiff", "  ", 1), ("d/e", " " + "n" * 40, 2)], "p string, d string, i int")
    rows = df.select(scalars.subset_name(F.col("p"), True, False), scalars.overlay_name(F.col("d"), F.col("i")), scalars.map_name(F.col("d"), F.col("i")), scalars.short_description(F.col("d"))).collect()
    assert [r[0] for r in rows] == ["x.y_filtered.ome.tiff", "c_filtered.ome.tiff", "e_filtered.ome.tiff"]
    assert [r[1] for r in rows] == ["ROI_0", "  ", " " + "n" * 40] and [r[2] for r in rows] == ["ROI_0", "ROI_1", "n" * 40]
    assert [r[3] for r in rows] == ["", "", "n" * 32 + "..."]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-1, 4), st.integers(-1, 3), st.sampled_from([-1.0, 0.0, 0.5, 3.0, 1e6])), min_size=1, max_size=40), st.integers(1, 5))
def test_partitions_do_not_matter(spark, rows, parts):
    made = catalog.select_rois(rois(spark, *(roi(i, 2 * i, i, 4, 3, i) for i in range(3))))
    rec = records(spark, rows)
    one = values(mosaic.mosaic(rec.coalesce(1), made))
    assert one == values(mosaic.mosaic(rec.repartition(parts, "v"), made))
    cells: dict = {}
    for r, x, y, v in rows:
        if 0 <= x < 4 and 0 <= y < 3:
            cells[r, y, x] = min(max(int(v), 0), 65535)
    want: dict = {}
    for r in (2, 1, 0):  # newest first, the oldest paints last
        for (k, y, x), v in cells.items():
            if k == r and v > 0:
                want[5 - r - 3 + y, 2 * r + x] = v
    assert one == want


def test_densify_takes_images_without_cells(spark):
    cells = spark.createDataFrame([(1, 0, 1, 0, 7)], "roi_id int, ch int, y int, x int, v int")
    dense = mosaic.densify(cells, 2, 1, 2, ["roi_id"], spark.createDataFrame([(1,), (2,)], "roi_id int"))
    got = {(r.roi_id, r.ch, r.y, r.x, r.v) for r in dense.collect()}
    assert got == {(i, c, y, 0, 7 * (i == 1 and c == 0 and y == 1)) for i in (1, 2) for c in (0, 1) for y in (0, 1)}
