"""Registered queries of the raster engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import indexspec, scalars
from pixelloom.operators import catalog, geometry, mosaic, reports
from pixelloom.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Building blocks of the SQL side.
_SHAPE_ROWS = ", ".join(f"({k}, {i}, {x}::DOUBLE, {y}::DOUBLE)" for k, s in B.SHAPES.items() for i, (x, y) in enumerate(s))


def _rois(mixed: bool = False) -> str:
    coarse = "n_nationkey % 3 = 0" if mixed else "false"
    return f"""base AS (SELECT n_nationkey AS roi_id, n_regionkey AS slide_ix, n_name AS description, (n_nationkey * 12) % 25 AS start_ts,
  (n_nationkey % 5) * 30::DOUBLE + CASE WHEN {coarse} THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS ox, floor(n_nationkey / 5) * 25::DOUBLE + CASE WHEN {coarse} THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS oy,
  CASE WHEN {coarse} THEN 2::DOUBLE ELSE 1::DOUBLE END AS px, CASE WHEN {coarse} THEN 20 ELSE 40 END AS w, CASE WHEN {coarse} THEN 15 ELSE 30 END AS h FROM nation),
rois AS (SELECT *, row_number() OVER (ORDER BY start_ts DESC, roi_id) - 1 AS roi_ix FROM base),
shape(kind, pos, dx, dy) AS (VALUES {_SHAPE_ROWS}),
corners AS (SELECT roi_id, pos, ox + dx AS x, oy + dy AS y FROM rois JOIN shape ON kind = CASE WHEN roi_id % 4 < 2 THEN 0 ELSE 1 END)"""


_RECORDS = """records AS (SELECT s_nationkey AS roi_id, l_linenumber - 1 AS ch, l_partkey % 42 AS x, l_orderkey % 31 AS y, l_extendedprice - 2000 AS v,
  l_orderkey * 10000000000000 + l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS rec_ord FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
cells AS (SELECT r.roi_id, ch, y, x, arg_max(v, rec_ord) AS v FROM records r JOIN rois USING (roi_id) WHERE x >= 0 AND x < w AND y >= 0 AND y < h GROUP BY ALL)"""
_U16 = "CAST(trunc(greatest(least({v}, 65535), 0)) AS BIGINT)"


def _canvas(which: str = "rois") -> str:
    return f"""canvas AS (SELECT min(x) AS bx, max(x) AS b2x, min(y) AS bym, max(y) AS b2y FROM corners WHERE roi_id IN (SELECT roi_id FROM {which})),
pitch AS (SELECT min(px) AS g FROM {which}),
size AS (SELECT CAST(ceil((b2x - bx) / g) AS BIGINT) AS cw, CAST(ceil((b2y - bym) / g) AS BIGINT) AS chh FROM canvas, pitch),
placed AS (SELECT r.roi_id, r.{"sel_ord" if which == "sel" else "roi_ix"} AS o, g, cw, chh, min(x) - bx AS mx, min(y) - bym AS my, CAST(ceil(any_value(h) * (any_value(px) / g)) AS BIGINT) AS hn, CAST(ceil(any_value(w) * (any_value(px) / g)) AS BIGINT) AS wn
  FROM {which} r JOIN corners USING (roi_id), canvas, pitch, size GROUP BY r.roi_id, 2, g, cw, chh, bx, bym),
placed2 AS (SELECT *, CAST(round_even(mx / g, 0) AS BIGINT) AS x0, chh - CAST(round_even(my / g, 0) AS BIGINT) - hn AS y0 FROM placed),
edges AS (SELECT a.roi_id, (a.x - bx - mx) / g AS px1, (a.y - bym - my) / g AS py1, (b.x - bx - mx) / g AS px2, (b.y - bym - my) / g AS py2
  FROM corners a JOIN (SELECT roi_id, max(pos) + 1 AS n FROM corners GROUP BY 1) c USING (roi_id) JOIN corners b ON b.roi_id = a.roi_id AND b.pos = (a.pos + 1) % n JOIN placed2 p ON p.roi_id = a.roi_id, canvas)"""


def _composite(source: str, cast: str) -> str:
    """From a CTE of cells (roi_id, ch, y, x, v) in canvas pitch to the mosaic."""
    return f"""outv AS (SELECT roi_id, ch, y, x, {cast} AS v FROM {source}),
spots AS (SELECT DISTINCT roi_id, y, x FROM outv WHERE v > 0),
hits AS (SELECT s.roi_id, s.y, s.x, count(*) FILTER (WHERE (py1 > s.y) <> (py2 > s.y) AND s.x < px1 + (px2 - px1) * (s.y - py1) / nullif(py2 - py1, 0)) AS n FROM spots s JOIN edges e ON e.roi_id = s.roi_id GROUP BY ALL)
SELECT ch::BIGINT AS ch, (greatest(0, y0) + v.y)::BIGINT AS y, (greatest(0, x0) + v.x)::BIGINT AS x, arg_max(v.v, o) AS v
FROM outv v JOIN hits h ON h.roi_id = v.roi_id AND h.y = v.y AND h.x = v.x AND n % 2 = 1 JOIN placed2 p ON p.roi_id = v.roi_id
WHERE v.v > 0 AND v.y < least(chh, y0 + hn) - greatest(0, y0) AND v.x < least(cw, x0 + wn) - greatest(0, x0) GROUP BY 1, 2, 3"""


def _selection(spec: list[int]) -> str:
    rows = ", ".join(f"({ix}, {k})" for k, ix in enumerate(spec))
    return f"sel AS (SELECT r.*, s.o AS sel_ord FROM rois r JOIN (VALUES {rows}) AS s(ix, o) ON r.roi_ix = s.ix)"


def _rois_df(spark, sf_dir, mixed=False) -> DataFrame:
    return catalog.load_rois(B.acquisitions(spark, sf_dir, mixed))


def _all(spark, sf_dir, mixed=False) -> DataFrame:
    return catalog.select_rois(_rois_df(spark, sf_dir, mixed))


SELECTION = "3,17,1,5-9,12"
SELECTED = [3, 17, 1, 5, 6, 7, 8, 9, 12]


@query(f"WITH {_rois()} SELECT roi_ix::BIGINT AS roi_ix, roi_id::BIGINT AS roi_id, slide_ix::BIGINT AS slide_ix, description FROM rois")
def q_catalog_order(spark, sf_dir):
    return longs(_rois_df(spark, sf_dir).select("roi_ix", "roi_id", "slide_ix", "description"), "roi_ix", "roi_id", "slide_ix")


@query(f"WITH {_rois()}, {_selection(SELECTED)} SELECT sel_ord::BIGINT AS sel_ord, roi_ix::BIGINT AS roi_ix, roi_id::BIGINT AS roi_id FROM sel")
def q_roi_select_ordered(spark, sf_dir):
    return longs(catalog.select_rois(_rois_df(spark, sf_dir), SELECTION).select("sel_ord", "roi_ix", "roi_id"), "sel_ord", "roi_ix", "roi_id")


SPECS = ["all", "0,2,5", "1-5", "3,5-6,2", "5-3", " 1 - 3 ", "0-2, 7,,1", ",", ""]
_PARTS = "SELECT i, s, trim(p) AS part, k FROM (SELECT i, s, unnest(string_split(s, ',')) AS p, generate_subscripts(string_split(s, ','), 1) AS k FROM spec WHERE s <> 'all') WHERE trim(p) <> ''"


@query(
    f"""WITH spec(i, s) AS (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(SPECS))}), parts AS ({_PARTS}),
ends AS (SELECT i, k, CAST(trim(string_split(part, '-')[1]) AS INT) AS lo, CAST(trim(CASE WHEN contains(part, '-') THEN string_split(part, '-')[2] ELSE part END) AS INT) AS hi FROM parts),
items AS (SELECT i, k, unnest(generate_series(lo, hi)) AS v FROM ends WHERE lo <= hi),
firsts AS (SELECT i, v, min(k * 100000 + v) AS place FROM items GROUP BY i, v),
lists AS (SELECT i, string_agg(v::VARCHAR, ',' ORDER BY place) AS l, string_agg(v::VARCHAR, ',' ORDER BY v) AS sorted FROM firsts GROUP BY i)
SELECT n_nationkey::BIGINT AS n, s AS spec, CASE WHEN s = 'all' THEN 'all' ELSE coalesce(l, '') END AS indices, coalesce(sorted, '') AS channels FROM nation JOIN spec ON n_nationkey % {len(SPECS)} = i LEFT JOIN lists USING (i)"""
)
def q_index_parse(spark, sf_dir):
    spec = F.element_at(F.array(*map(F.lit, SPECS)), (F.col("n_nationkey") % len(SPECS) + 1).cast("int"))
    d = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), spec.alias("spec")).withColumn("ix", indexspec.indices_column(F.col("spec")))
    return d.select("n", "spec", F.coalesce(F.array_join("ix", ","), F.lit("all")).alias("indices"), F.coalesce(F.array_join(F.sort_array("ix"), ","), F.lit("")).alias("channels"))


@query(f"WITH {_rois()}, {_RECORDS} SELECT r.roi_id::BIGINT AS roi_id, r.ch::BIGINT AS ch, r.y::BIGINT AS y, r.x::BIGINT AS x, rec_ord::BIGINT AS rec_ord FROM records r JOIN rois USING (roi_id) WHERE x < w AND y < h")
def q_bounds_filter(spark, sf_dir):
    return longs(mosaic.in_bounds(B.records(spark, sf_dir), _rois_df(spark, sf_dir)).select("roi_id", "ch", "y", "x", "rec_ord"), "roi_id", "ch", "y", "x")


@query(f"WITH {_rois()}, {_RECORDS} SELECT roi_id::BIGINT AS roi_id, ch::BIGINT AS ch, y::BIGINT AS y, x::BIGINT AS x, CAST(round(v * 100) AS BIGINT) AS cents FROM cells")
def q_record_scatter(spark, sf_dir):
    cells = mosaic.scatter(mosaic.in_bounds(B.records(spark, sf_dir), _rois_df(spark, sf_dir)))
    return longs(cells.select("roi_id", "ch", "y", "x", F.round(F.col("v") * 100).cast("long").alias("cents")), "roi_id", "ch", "y", "x")


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {_U16.format(v='l_extendedprice * 2 - 4000')} AS v FROM lineitem")
def q_cast_u16(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), scalars.to_output(F.col("l_extendedprice") * 2 - 4000, "uint16").cast("long").alias("v"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CAST(round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) * 10) AS BIGINT) AS v FROM lineitem")
def q_cast_f32(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(scalars.to_output(F.col("l_extendedprice"), "float32").cast("double") * 10).cast("long").alias("v"))


@query(
    """WITH seg AS (SELECT s_suppkey AS seg_id, (s_suppkey % 8 + 1)::BIGINT AS c, CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 3 END::BIGINT AS vb, (s_suppkey * 13)::BIGINT AS a, (s_suppkey * 13 + (s_suppkey % 50) * (s_suppkey % 8 + 4) * 8 + s_suppkey % 3)::BIGINT AS b FROM supplier),
n AS (SELECT *, (c + 3) * vb AS stride FROM seg)
SELECT seg_id, CASE WHEN vb NOT IN (2, 4, 8) THEN 'unsupported' WHEN (b - a) % stride <> 0 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN vb NOT IN (2, 4, 8) OR (b - a) % stride <> 0 THEN 0 ELSE (b - a) // stride END::BIGINT AS strict_records, CASE WHEN vb NOT IN (2, 4, 8) THEN 0 ELSE (b - a) // stride END::BIGINT AS recovered, CASE vb WHEN 2 THEN 'float16' WHEN 4 THEN 'float32' WHEN 8 THEN 'float64' END AS value_type FROM n"""
)
def q_segment_check(spark, sf_dir):
    s = F.col("s_suppkey")
    seg = B.table(spark, sf_dir, "supplier").select(
        s.alias("seg_id"), (s % 8 + 1).alias("num_channels"), F.when(s % 4 == 0, 2).when(s % 4 == 1, 4).when(s % 4 == 2, 8).otherwise(3).alias("value_bytes"), (s * 13).alias("data_start"), (s * 13 + (s % 50) * (s % 8 + 4) * 8 + s % 3).alias("data_end")
    )
    strict = mosaic.segment_check(seg).withColumnRenamed("n_records", "strict_records")
    return mosaic.segment_check(strict, strict=False).select("seg_id", "status", "strict_records", F.col("n_records").alias("recovered"), scalars.value_type(F.col("value_bytes")).alias("value_type"))


@query(f"WITH {_rois()}, {_selection(SELECTED)}, c AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM corners WHERE roi_id IN (SELECT roi_id FROM sel)) SELECT k.roi_id::BIGINT AS roi_id, pos::BIGINT AS pos, x - min_x AS tx, y - min_y AS ty, max_x - min_x AS w_um, max_y - min_y AS h_um FROM corners k, c WHERE roi_id IN (SELECT roi_id FROM sel)")
def q_canvas_bounds(spark, sf_dir):
    sel = catalog.select_rois(_rois_df(spark, sf_dir), SELECTION)
    t = geometry.translate(sel, geometry.canvas(sel))
    t = t.select("roi_id", F.posexplode("translated").alias("pos", "p"), (F.col("c_max_x") - F.col("c_min_x")).alias("w_um"), (F.col("c_max_y") - F.col("c_min_y")).alias("h_um"))
    return longs(t.select("roi_id", "pos", F.col("p.x").alias("tx"), F.col("p.y").alias("ty"), "w_um", "h_um"), "roi_id", "pos")


@query(
    f"""WITH {_rois(True)}, p AS (SELECT min(px) AS g FROM rois), c AS (SELECT max(x) - min(x) AS w, max(y) - min(y) AS h FROM corners)
SELECT roi_id::BIGINT AS roi_id, g, abs(px - g) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(g) AS same, CAST(ceil(c.w / g) AS BIGINT) AS canvas_w, CAST(ceil(c.h / g) AS BIGINT) AS canvas_h FROM rois, p, c"""
)
def q_global_pitch(spark, sf_dir):
    r = _rois_df(spark, sf_dir, True)
    return longs(r.crossJoin(F.broadcast(geometry.canvas(r))).select("roi_id", "g", scalars.is_close(F.col("px_x"), F.col("g")).alias("same"), "canvas_w", "canvas_h"), "roi_id")


@query(f"WITH {_rois(True)}, {_canvas()} SELECT roi_id::BIGINT AS roi_id, x0, y0, hn AS h_new, wn AS w_new, greatest(0, y0)::BIGINT AS top, greatest(0, x0)::BIGINT AS left_, least(chh, y0 + hn)::BIGINT AS bottom, least(cw, x0 + wn)::BIGINT AS right_ FROM placed2")
def q_placement(spark, sf_dir):
    r = _rois_df(spark, sf_dir, True)
    return longs(geometry.place(r, geometry.canvas(r)).select("roi_id", "x0", "y0", "h_new", "w_new", "top", F.col("left").alias("left_"), "bottom", F.col("right").alias("right_")), "roi_id")


@query(
    f"""WITH {_rois()}, {_canvas()}, grid AS (SELECT roi_id, unnest(generate_series(0, 29)) AS y, px FROM rois), g2 AS (SELECT roi_id, y, unnest(generate_series(0, 39)) AS x FROM grid)
SELECT t.roi_id::BIGINT AS roi_id, t.y::BIGINT AS y, t.x::BIGINT AS x FROM g2 t JOIN edges e ON e.roi_id = t.roi_id GROUP BY ALL HAVING count(*) FILTER (WHERE (py1 > t.y) <> (py2 > t.y) AND t.x < px1 + (px2 - px1) * (t.y - py1) / nullif(py2 - py1, 0)) % 2 = 1"""
)
def q_polygon_mask(spark, sf_dir):
    r = _rois_df(spark, sf_dir)
    p = geometry.local(geometry.place(r, geometry.canvas(r))).select("roi_id", *geometry.MASK, "w_new", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h_new") - 1)).alias("y"))
    p = p.select("roi_id", *geometry.MASK, "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w_new") - 1)).alias("x"))
    return longs(p.where(geometry.in_polygon(F.col("x").cast("double"), F.col("y").cast("double"))).select("roi_id", "y", "x"), "roi_id")


@query(f"WITH {_rois()}, {_RECORDS}, {_canvas()}, {_composite('cells', _U16.format(v='v'))}")
def q_mosaic_u16(spark, sf_dir):
    return longs(mosaic.mosaic(B.records(spark, sf_dir), _all(spark, sf_dir)), "ch", "y", "x", "v")


@query(f"WITH {_rois()}, {_RECORDS}, {_canvas()}, m AS (WITH {_composite('cells', 'CAST(v AS FLOAT)')}) SELECT ch, y, x, CAST(round(CAST(v AS DOUBLE) * 10) AS BIGINT) AS v FROM m")
def q_mosaic_f32(spark, sf_dir):
    m = mosaic.mosaic(B.records(spark, sf_dir), _all(spark, sf_dir), "float32")
    return longs(m.withColumn("v", F.round(F.col("v").cast("double") * 10)), "ch", "y", "x", "v")


@query(f"WITH {_rois()}, {_selection(SELECTED)}, {_RECORDS}, {_canvas('sel')}, chosen AS (SELECT * FROM cells WHERE roi_id IN (SELECT roi_id FROM sel)), {_composite('chosen', _U16.format(v='v'))}")
def q_mosaic_selected(spark, sf_dir):
    return longs(mosaic.mosaic(B.records(spark, sf_dir), catalog.select_rois(_rois_df(spark, sf_dir), SELECTION)), "ch", "y", "x", "v")


_AXIS = """{a}c AS (SELECT *, (i + 0.5::DOUBLE) * n / nn - 0.5::DOUBLE AS c FROM (SELECT DISTINCT {s} AS n, {t} AS nn, unnest(generate_series(0, {t} - 1)) AS i FROM placed2 JOIN rois USING (roi_id) WHERE px <> g)),
{a}n AS (SELECT n, i, CAST(floor(c) AS BIGINT) AS k, 1 - (c - floor(c)) AS wt FROM {a}c UNION ALL SELECT n, i, CAST(floor(c) AS BIGINT) + 1, c - floor(c) FROM {a}c),
{a} AS (SELECT n, i, CASE WHEN n = 1 THEN 0 WHEN k < 0 THEN -k WHEN k >= n THEN 2 * (n - 1) - k ELSE k END AS at, wt FROM {a}n)"""


@query(
    f"""WITH {_rois(True)}, {_RECORDS}, {_canvas()}, {_AXIS.format(a="wy", s="h", t="hn")}, {_AXIS.format(a="wx", s="w", t="wn")},
res AS (SELECT roi_id, ch, y, x, v FROM cells JOIN rois USING (roi_id), pitch WHERE px = g
 UNION ALL SELECT c.roi_id, ch, wy.i, wx.i, sum(v * wy.wt * wx.wt) FROM cells c JOIN rois r USING (roi_id) JOIN wy ON wy.n = r.h AND wy.at = c.y AND wy.wt > 0 JOIN wx ON wx.n = r.w AND wx.at = c.x AND wx.wt > 0, pitch WHERE px <> g GROUP BY ALL),
{_composite("res", _U16.format(v="round(v, 6)"))}"""
)
def q_resample(spark, sf_dir):
    return longs(mosaic.mosaic(B.records(spark, sf_dir), _all(spark, sf_dir, True), digits=6), "ch", "y", "x", "v")


@query(
    f"""WITH {_rois()}, {_RECORDS}, full_grid AS (SELECT roi_id, ch, y, unnest(generate_series(0, 39)) AS x FROM (SELECT roi_id, ch, unnest(generate_series(0, 29)) AS y FROM (SELECT roi_id, unnest(generate_series(0, 6)) AS ch FROM rois)))
SELECT g.roi_id::BIGINT AS roi_id, g.ch::BIGINT AS ch, g.y::BIGINT AS y, g.x::BIGINT AS x, CASE WHEN v IS NULL THEN 0 ELSE {_U16.format(v="v")} END AS v FROM full_grid g LEFT JOIN cells c ON c.roi_id = g.roi_id AND c.ch = g.ch AND c.y = g.y AND c.x = g.x"""
)
def q_densify(spark, sf_dir):
    rois = _rois_df(spark, sf_dir)
    dense = mosaic.densify(mosaic.region_images(B.records(spark, sf_dir), rois), 30, 40, B.N_CHANNELS, ["roi_id"], rois)
    return longs(dense.select("roi_id", "ch", "y", "x", "v"), "roi_id", "ch", "y", "x", "v")


_CUBES = "cubes AS (SELECT image_id, ch, pos // 8 AS y, pos % 8 AS x, CAST(floor(CAST(value AS DOUBLE) * 1000) AS BIGINT) AS v FROM (SELECT vec_id AS image_id, vec_id % 5 AS ch, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"


@query(f"WITH {_CUBES} SELECT image_id, ch::BIGINT AS ch, level::BIGINT AS level, (y // (1 << level))::BIGINT AS y, (x // (1 << level))::BIGINT AS x, v FROM cubes, (VALUES (0), (1), (2), (3)) AS l(level) WHERE y % (1 << level) = 0 AND x % (1 << level) = 0")
def q_pyramid(spark, sf_dir):
    return longs(mosaic.pyramid(B.cubes(spark, sf_dir)).select("image_id", "ch", "level", "y", "x", "v"), "ch", "level", "y", "x")


@query(f"WITH {_CUBES} SELECT image_id, (CASE ch WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END)::BIGINT AS new_ch, 'CH' || ch AS label, y::BIGINT AS y, x::BIGINT AS x, v FROM cubes WHERE ch IN (0, 2, 4)")
def q_channel_subset(spark, sf_dir):
    picked = [c for c in indexspec.parse_channels("4,0-0,2,9") if c < 5]
    names = catalog.channel_names(F.array(*(F.lit(f"CH{i}") for i in range(5))), picked)
    d = catalog.select_channels(B.cubes(spark, sf_dir), picked)
    return longs(d.select("image_id", "new_ch", F.get(names, F.col("new_ch")).alias("label"), "y", "x", "v"), "new_ch", "y", "x")


@query(f"WITH {_CUBES} SELECT image_id, list_position([0, 2, 4], ch)::BIGINT - 1 AS new_ch, count(*) AS n, sum(v)::BIGINT AS total FROM cubes WHERE ch IN (0, 2, 4) GROUP BY ALL")
def q_channel_sort(spark, sf_dir):
    d = catalog.select_channels(B.cubes(spark, sf_dir), indexspec.parse_channels("4,2,0,2"))
    return longs(d.groupBy("image_id", "new_ch").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "new_ch")


@query(f"WITH {_rois()}, {_RECORDS}, {_canvas()}, m AS (WITH {_composite('cells', _U16.format(v='v'))}) SELECT ch, (y // 64)::BIGINT AS ty, (x // 64)::BIGINT AS tx, count(*) AS n, sum(v)::BIGINT AS total, max((y % 64) * 64 + x % 64)::BIGINT AS last FROM m GROUP BY ALL")
def q_tiling(spark, sf_dir):
    t = mosaic.tiles(mosaic.mosaic(B.records(spark, sf_dir), _all(spark, sf_dir)), 64)
    return longs(t.groupBy("ch", "ty", "tx").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max(F.col("iy") * 64 + F.col("ix")).alias("last")), "ch", "ty", "tx", "total", "last")


_PANOS = "panos AS (SELECT r_regionkey AS k, r_name AS description, -10::DOUBLE - r_regionkey AS x1, 170::DOUBLE + 2 * r_regionkey AS x2, -5::DOUBLE - r_regionkey AS y1, 140::DOUBLE + 3 * r_regionkey AS y2, 3000 + 500 * r_regionkey AS side FROM region)"


@query(f"WITH {_PANOS} SELECT k::BIGINT AS flat_ix, k::BIGINT AS slide_ix, 0::BIGINT AS pano_ix, description FROM panos WHERE k IN (4, 0, 2)")
def q_pano_flatten(spark, sf_dir):
    d = catalog.select_panoramas(catalog.flatten_panoramas(B.panoramas(spark, sf_dir)), "4,0,2,9")
    return longs(d.select("flat_ix", "slide_ix", "pano_ix", "description"), "flat_ix", "slide_ix", "pano_ix")


@query(f"WITH {_PANOS} SELECT k::BIGINT AS slide_ix, x1 AS p_min_x, x2 AS p_max_x, y1 AS p_min_y, y2 AS p_max_y, 'ok' AS box_status FROM panos")
def q_pano_bounds(spark, sf_dir):
    return longs(geometry.panorama_bounds(B.panoramas(spark, sf_dir)).select("slide_ix", "p_min_x", "p_max_x", "p_min_y", "p_max_y", "box_status"), "slide_ix")


@query(f"WITH {_PANOS} SELECT k::BIGINT AS slide_ix, CASE WHEN k = 1 THEN 'missing' WHEN k = 3 THEN 'degenerate' ELSE 'ok' END AS box_status, CASE WHEN k IN (1, 3) THEN NULL ELSE CAST(round((5 - x1) * side / (x2 - x1) * 1000) AS BIGINT) END AS px FROM panos")
def q_pano_bounds_check(spark, sf_dir):
    bad = F.when(F.col("slide_ix") == 1, F.slice("corners", 1, 3)).when(F.col("slide_ix") == 3, F.transform("corners", lambda p: F.struct(F.lit(7.0).alias("x"), p["y"].alias("y")))).otherwise(F.col("corners"))
    d = geometry.panorama_bounds(B.panoramas(spark, sf_dir).withColumn("corners", bad))
    px, _ = geometry.slide_to_panorama(F.lit(5.0), F.lit(5.0))
    return longs(d.select("slide_ix", "box_status", F.when(F.col("box_status") == "ok", F.round(px * 1000).cast("long")).alias("px")), "slide_ix")


def _mapped(spark, sf_dir, panoramas=None) -> DataFrame:
    """Panorama x region on its slide, with corners in panorama pixels (``points``)."""
    p = geometry.panorama_bounds(panoramas if panoramas is not None else B.panoramas(spark, sf_dir)).where("box_status = 'ok'").select("slide_ix", "pano_ix", "width_px", "height_px", "p_min_x", "p_max_x", "p_min_y", "p_max_y")
    return geometry.in_panorama(_rois_df(spark, sf_dir), p, ["slide_ix"])


_PX = "(c.x - x1) * (side / (x2 - x1))"
_PY = "(y2 - c.y) * (side / (y2 - y1))"


@query(f"WITH {_rois()}, {_PANOS} SELECT r.slide_ix::BIGINT AS slide_ix, roi_ix::BIGINT AS roi_ix, trim(r.description) AS name, CASE pos WHEN 0 THEN 'top_left' WHEN 1 THEN 'top_right' WHEN 2 THEN 'bottom_right' ELSE 'bottom_left' END AS corner, CAST(round({_PX} * 1000) AS BIGINT) AS px, CAST(round({_PY} * 1000) AS BIGINT) AS py FROM rois r JOIN corners c USING (roi_id) JOIN panos ON k = r.slide_ix WHERE pos < 4")
def q_pano_map(spark, sf_dir):
    labels = F.array(*map(F.lit, ["top_left", "top_right", "bottom_right", "bottom_left"]))
    d = _mapped(spark, sf_dir).select("slide_ix", "roi_ix", scalars.map_name(F.col("description"), F.col("roi_ix")).alias("name"), F.posexplode(F.slice("points", 1, 4)).alias("pos", "p"))
    return longs(d.select("slide_ix", "roi_ix", "name", F.get(labels, F.col("pos")).alias("corner"), F.round(F.col("p.x") * 1000).alias("px"), F.round(F.col("p.y") * 1000).alias("py")), "slide_ix", "roi_ix", "px", "py")


@query(
    f"""WITH {_rois()}, {_PANOS}, pts AS (SELECT r.slide_ix, roi_ix, description, {_PX} AS px, {_PY} AS py FROM (SELECT roi_id, slide_ix, roi_ix, description FROM rois) r JOIN corners c USING (roi_id) JOIN (SELECT k, x1, x2, y1, y2, side FROM panos WHERE side >= 4000) ON k = r.slide_ix),
g AS (SELECT slide_ix, roi_ix, description, greatest(max(px) - min(px), max(py) - min(py)) AS e, avg(px) AS cx, avg(py) AS cy FROM pts GROUP BY ALL)
SELECT slide_ix::BIGINT AS slide_ix, roi_ix::BIGINT AS roi_ix, description AS name, list_extract(['#ff0000','#00ff00','#0000ff','#ffff00','#ff00ff','#00ffff','#ff8000','#8000ff'], (roi_ix % 8 + 1)::INT) AS colour, greatest(2, least(10, CAST(trunc(e / 100) AS BIGINT)))::BIGINT AS line_width, greatest(10, least(192, CAST(trunc(pow(e, 0.7) - 20) AS BIGINT)))::BIGINT AS font_size, CAST(round(cx * 100) AS BIGINT) AS centre_x, CAST(round(cy * 100) AS BIGINT) AS centre_y FROM g"""
)
def q_overlay_geometry(spark, sf_dir):
    d = geometry.overlay_geometry(_mapped(spark, sf_dir).where("width_px >= 4000 and height_px >= 4000"))
    return longs(d.select("slide_ix", "roi_ix", scalars.overlay_name(F.col("description"), F.col("roi_ix")).alias("name"), "colour", "line_width", "font_size", F.round(F.col("centre_x") * 100).alias("centre_x"), F.round(F.col("centre_y") * 100).alias("centre_y")), "slide_ix", "roi_ix", "line_width", "font_size", "centre_x", "centre_y")


@query(f"WITH {_rois()}, {_PANOS} SELECT r.slide_ix::BIGINT AS slide_ix, roi_ix::BIGINT AS roi_ix, pos::BIGINT AS pos, CAST(round({_PX} * 1000) AS BIGINT) AS px, CAST(round({_PY} * 1000) AS BIGINT) AS py FROM rois r JOIN corners c USING (roi_id) JOIN panos ON k = r.slide_ix")
def q_overlay_polygons(spark, sf_dir):
    d = _mapped(spark, sf_dir).select("slide_ix", "roi_ix", F.posexplode("points").alias("pos", "p"))
    return longs(d.select("slide_ix", "roi_ix", "pos", F.round(F.col("p.x") * 1000).alias("px"), F.round(F.col("p.y") * 1000).alias("py")), "slide_ix", "roi_ix", "pos", "px", "py")


@query(
    """WITH e AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '.1234567' ELSE '' END END AS raw, CASE WHEN event_id % 3 = 0 THEN ' a description that is far too long to be shown ' || event_id ELSE ' ' || event_type || ' ' END AS d FROM events)
SELECT event_id, CASE WHEN length(trim(d)) > 35 THEN substr(trim(d), 1, 32) || '...' ELSE trim(d) END AS description, CASE WHEN raw IS NULL THEN '' WHEN raw = 'unknown' THEN raw ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp, (event_id % 900) || 'x' || (event_id % 700) AS size FROM e"""
)
def q_metadata_report(spark, sf_dir):
    e = F.col("event_id")
    shown = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(e % 2 == 0, ".1234567").otherwise(""))
    raw = F.when(e % 7 == 0, None).when(e % 7 == 1, "unknown").otherwise(shown)
    d = F.when(e % 3 == 0, F.concat(F.lit(" a description that is far too long to be shown "), e.cast("string"))).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return B.table(spark, sf_dir, "events").select("event_id", scalars.short_description(d).alias("description"), scalars.display_timestamp(raw).alias("stamp"), F.format_string("%dx%d", e % 900, e % 700).alias("size"))


@query("SELECT l_linenumber::BIGINT - 1 AS ch, 'CH' || (l_linenumber - 1) AS label, (SELECT string_agg('CH' || c, ', ' ORDER BY c) FROM (SELECT DISTINCT l_linenumber - 1 AS c FROM lineitem)) AS channels, count(*) AS n FROM lineitem GROUP BY ALL")
def q_channel_list(spark, sf_dir):
    n = B.table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("ch")).agg(F.count("*").alias("n")).withColumn("label", F.concat(F.lit("CH"), F.col("ch").cast("string")))
    joined = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ch", "label"))), lambda p: p["label"]), ", ").alias("channels"))
    return longs(n.crossJoin(F.broadcast(joined)).select("ch", "label", "channels", "n"), "ch")


@query(
    """WITH p AS (SELECT page_id, url, 'out/' || page_id || '/roi.ome.' || (page_id % 3) || '.ome.tiff' AS path FROM pages)
SELECT page_id, 'roi.ome.' || (page_id % 3) || '.ome' AS stem, 'out/' || page_id AS parent, 'roi.' || (page_id % 3) || '_filtered_pyramid.ome.tiff' AS both_name, 'roi.' || (page_id % 3) || '.ome.tiff' AS plain, 'converted' AS kind FROM p
UNION ALL SELECT page_id, 'roi.ome.' || (page_id % 3) || '.ome', 'out/' || page_id, 'roi.' || (page_id % 3) || '_filtered_pyramid.ome.tiff', 'roi.' || (page_id % 3) || '.ome.tiff', 'stitched' FROM p WHERE page_id % 10 = 0"""
)
def q_output_names(spark, sf_dir):
    i = F.col("page_id").cast("string")
    path = F.concat(F.lit("out/"), i, F.lit("/roi.ome."), (F.col("page_id") % 3).cast("string"), F.lit(".ome.tiff"))
    d = B.table(spark, sf_dir, "pages").select("page_id", scalars.stem(path).alias("stem"), scalars.parent(path).alias("parent"), scalars.subset_name(path, True, True).alias("both_name"), scalars.subset_name(path, False, False).alias("plain"))
    return d.withColumn("kind", F.lit("converted")).unionByName(d.where("page_id % 10 = 0").withColumn("kind", F.lit("stitched")))


@query(
    f"""WITH {_rois()} SELECT roi_id::BIGINT AS roi_id, slide_ix::BIGINT AS slide_ix, row_number() OVER (ORDER BY slide_ix, roi_id) - 1 AS catalog_ord, 1 + (roi_id % 3)::BIGINT * 2 + CASE WHEN roi_id % 3 = 0 THEN 3 ELSE 1 END AS value_bytes,
  CASE WHEN roi_id % 5 = 0 THEN 40 ELSE 39 END::BIGINT AS max_x, 30::BIGINT AS max_y, CASE WHEN roi_id % 2 = 0 THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS ablation_x, 1::DOUBLE AS ablation_y, (roi_id * 100)::BIGINT AS data_start, CASE WHEN roi_id % 7 = 0 THEN NULL ELSE roi_id * 100 + 50 END::BIGINT AS data_end,
  7::BIGINT AS num_channels, 7::BIGINT AS first_channels FROM rois"""
)
def q_roi_flat_record(spark, sf_dir):
    r = F.col("roi_id")
    text = lambda c: c.cast("string")
    entries = {"ValueBytes": F.when(r % 3 != 0, text(2 + r % 3 * 2)), "MaxX": F.when(r % 5 != 0, "39"), "AblationDistanceBetweenShotsX": F.when(r % 2 == 0, "n/a").otherwise("0.5"), "DataStartOffset": text(r * 100), "DataEndOffset": F.when(r % 7 != 0, text(r * 100 + 50))}
    metadata = F.map_filter(F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    fields = ["acq_id", "description", "corners", "px_x", "px_y", "width", "height", "channel_labels", F.when(r % 2 == 0, F.col("num_channels")).alias("num_channels"), metadata.alias("metadata")]
    one = B.acquisitions(spark, sf_dir).groupBy("file_id", "slide_ix").agg(F.array_sort(F.collect_list(F.struct("roi_id", F.struct(*fields).alias("a"))), lambda x, y: x["roi_id"] - y["roi_id"]).alias("all"))
    nested = one.select("file_id", "slide_ix", F.transform("all", lambda x: x["a"]).cast(f"array<{catalog.ACQUISITION}>").alias("acquisitions"))
    flat = catalog.flat_record(nested).withColumn("roi_id", F.col("acq_id").cast("long"))
    first = catalog.first_roi(_all(spark, sf_dir)).select(F.col("num_channels").cast("long").alias("first_channels"))
    out = flat.crossJoin(F.broadcast(first)).select("roi_id", "slide_ix", "catalog_ord", "value_bytes", "max_x", "max_y", "ablation_x", "ablation_y", "data_start", "data_end", "num_channels", "first_channels")
    return longs(out, "slide_ix", "catalog_ord", "value_bytes", "max_x", "max_y", "num_channels")


@query(
    """WITH acq AS (SELECT n_nationkey AS roi_id, n_regionkey % 2 AS file, n_nationkey AS catalog_ord, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey % 3 END AS start_ts, n_nationkey % 6 IN (2, 5) AS bare FROM nation)
SELECT 'f' || file AS file_id, roi_id::BIGINT AS roi_id, row_number() OVER (PARTITION BY file ORDER BY start_ts DESC NULLS LAST, catalog_ord) - 1 AS roi_ix FROM acq WHERE NOT bare"""
)
def q_catalog_ties(spark, sf_dir):
    """Ties and missing timestamps, regions with no or an empty polygon, two files."""
    n = F.col("roi_id")
    d = B.acquisitions(spark, sf_dir).withColumns({"file_id": F.concat(F.lit("f"), (F.col("slide_ix") % 2).cast("string")), "start_ts": F.when(n % 4 != 0, n % 3)})
    nothing = F.when(n % 6 == 2, F.array().cast(d.schema["corners"].dataType)).when(n % 6 != 5, F.col("corners"))
    return longs(catalog.load_rois(d.withColumn("corners", nothing)).select("file_id", "roi_id", "roi_ix"), "roi_id", "roi_ix")


@query(f"""WITH {_rois()}, {_RECORDS} SELECT r.roi_id::BIGINT AS roi_id, r.ch::BIGINT AS ch, r.y::BIGINT AS y, r.x::BIGINT AS x, rec_ord::BIGINT AS rec_ord FROM records r JOIN rois USING (roi_id) WHERE x < w AND y < h AND rec_ord % 7 > 3""")
def q_bounds_odd(spark, sf_dir):
    """Coordinates that are NaN, infinite or beyond any integer are outside; fractions are truncated toward zero."""
    # By place, so that the remainder is taken once a coordinate; what has no place keeps its own.
    k = (F.col("rec_ord") % 7).cast("int")
    number = lambda s: F.lit(s).cast("double")
    at = lambda own, *places: F.coalesce(F.get(F.array(*places), k), own)
    x, y, none = F.col("x").cast("double"), F.col("y").cast("double"), number(None)
    x = at(x, number("NaN"), number("Infinity"), number(-1e300), none, x + 0.9)
    y = at(y, none, none, none, number(-1e12), none, F.when(y == 0, -0.9))
    records = B.records(spark, sf_dir).withColumns({"x": x, "y": y})
    return longs(mosaic.in_bounds(records, _rois_df(spark, sf_dir)).select("roi_id", "ch", "y", "x", "rec_ord"), "roi_id", "ch", "y", "x")


@query("WITH made AS (SELECT n_nationkey AS k, 'conv/' || n_name || CASE WHEN n_nationkey % 4 = 0 THEN '.TIFF' WHEN n_nationkey % 4 = 1 THEN '.tif' ELSE '.tiff' END AS path FROM nation) SELECT k::BIGINT AS k, path FROM made WHERE k % 3 <> 0 AND lower(path) LIKE '%.tiff'")
def q_produced_exists(spark, sf_dir):
    k = F.col("n_nationkey")
    made = B.table(spark, sf_dir, "nation").select(k.cast("long").alias("k"), F.concat(F.lit("conv/"), "n_name", F.when(k % 4 == 0, ".TIFF").when(k % 4 == 1, ".tif").otherwise(".tiff")).alias("path"))
    return made.where(F.lower("path").endswith(".tiff")).join(made.where("k % 3 != 0").select("path"), "path", "left_semi").select("k", "path")


@query(f"WITH {_PANOS} SELECT k::BIGINT AS flat_ix, 'mcd_slide_' || k || '_pano_0.png' AS path, side::BIGINT AS w, side >= 4000 AND k <> 4 AS overlay, CASE WHEN k = 4 THEN 'unresolved' ELSE 'ok' END AS status FROM panos WHERE k <> 1")
def q_pano_export_plan(spark, sf_dir):
    flat = catalog.select_panoramas(catalog.flatten_panoramas(B.panoramas(spark, sf_dir)), "0,2-4,7")
    resolved = flat.where("slide_ix != 4").select("slide_ix", "pano_ix", "width_px", "height_px")
    return longs(reports.panorama_plan(flat.drop("width_px", "height_px"), resolved, "mcd").select("flat_ix", "path", F.coalesce("width_px", 3000 + 500 * F.col("slide_ix")).alias("w"), "overlay", "status"), "flat_ix", "w")


@query("SELECT (SELECT count(*) FROM nation) AS rois, (SELECT count(DISTINCT n_regionkey) FROM nation) AS slides, (SELECT count(*) FROM region) AS panoramas, (SELECT count(DISTINCT l_linenumber) FROM lineitem) AS channels")
def q_counts(spark, sf_dir):
    r = _rois_df(spark, sf_dir).agg(F.count("*").alias("rois"), F.count_distinct("slide_ix").alias("slides"))
    p = B.panoramas(spark, sf_dir).agg(F.count("*").alias("panoramas"))
    c = B.table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_linenumber").alias("channels"))
    return r.crossJoin(p).crossJoin(c)


_XML = "replace(replace(replace(replace({v}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    f"""WITH {_rois()}, c AS (SELECT unnest(range(7)) AS k), named AS (SELECT roi_id, description || ' <' || roi_id || '> & "x"' AS name FROM rois)
SELECT roi_id::BIGINT AS roi_id, '<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10) || '<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06" Creator="pixelloom 0.1.0">' || chr(10) || '  <Instrument ID="Instrument:StandardBioToolsInstrument" />' || chr(10)
 || '  <Image ID="Image:' || roi_id || '" Name="' || {_XML.format(v="name")} || '">' || chr(10) || '    <Pixels ID="Pixels:' || roi_id || '" DimensionOrder="XYZCT" Type="uint16" SizeX="40" SizeY="30" SizeZ="1" SizeC="7" SizeT="1" PhysicalSizeX="' || CASE WHEN roi_id % 2 = 0 THEN '1.0' ELSE '0.25' END || '" PhysicalSizeY="2.0">' || chr(10)
 || (SELECT string_agg('      <Channel ID="Channel:' || roi_id || ':' || k || '" Name="CH' || k || '" SamplesPerPixel="1" />' || chr(10), '' ORDER BY k) FROM c) || (SELECT string_agg('      <TiffData FirstC="' || k || '" FirstZ="0" FirstT="0" IFD="' || k || '" PlaneCount="1" />' || chr(10), '' ORDER BY k) FROM c)
 || '    </Pixels>' || chr(10) || '  </Image>' || chr(10) || '</OME>' AS xml FROM named"""
)
def q_ome_xml(spark, sf_dir):
    """The whole document, as the writers put it into a file."""
    from pixelloom.sources import ome

    name = F.concat("description", F.lit(" <"), F.col("roi_id").cast("string"), F.lit('> & "x"'))
    d = _rois_df(spark, sf_dir).select("roi_id", name.alias("name"), "channel_labels", "width", "height", F.when(F.col("roi_id") % 2 == 0, 1.0).otherwise(0.25).alias("pitch"))
    return longs(ome.documents(d.select("roi_id", F.struct("name", "channel_labels", "width", "height", "pitch", F.lit(2.0).alias("pitch_y"), F.col("roi_id").cast("string").alias("id")).alias("image"))), "roi_id")


_LINES = "SELECT {flat} AS flat_ix, {section}::BIGINT AS section, {block}::BIGINT AS block, {line}::BIGINT AS line, {text} AS text"
_CORNER = "list_extract(['top_left', 'top_right', 'bottom_right', 'bottom_left'], {i})"


def _fixed(*lines: str) -> str:
    """Numbered lines as rows (line, text)."""
    return "(VALUES " + ", ".join(f"({k}, {x})" for k, x in enumerate(lines)) + ") AS t(line, text)"


@query(
    f"""WITH {_rois(True)}, {_selection(SELECTED)}, {_PANOS}, p AS (SELECT * FROM panos WHERE k IN (0, 3)),
c AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS b_y, (SELECT min(px) FROM sel) AS g FROM corners WHERE roi_id IN (SELECT roi_id FROM sel)),
ends AS (SELECT p.*, i, CASE WHEN i IN (1, 4) THEN ax ELSE bx END AS cx, CASE WHEN i < 3 THEN b_y ELSE ay END AS cy FROM p, c, (SELECT unnest(range(1, 5)) AS i)),
spots AS (SELECT s.sel_ord, pos, p.k, (c.x - x1) * (side / (x2 - x1)) AS px, (y2 - c.y) * (side / (y2 - y1)) AS py FROM sel s JOIN corners c USING (roi_id), p WHERE pos < 4),
tops AS (SELECT k, unnest(['Stitched-ROIs to Panorama Mapping', repeat('=', 40), '', 'stitched_canvas_pixels: ' || CAST(ceil((bx - ax) / g) AS BIGINT) || ' x ' || CAST(ceil((b_y - ay) / g) AS BIGINT),
  format('stitched_canvas_slide_um: x_min={{:.3f}} x_max={{:.3f}} y_min={{:.3f}} y_max={{:.3f}}', ax, bx, ay, b_y), 'panorama_pixels: ' || side || ' x ' || side, format('panorama_slide_um: x_min={{:.1f}} x_max={{:.1f}} y_min={{:.1f}} y_max={{:.1f}}', x1, x2, y1, y2), '', 'corner_mapping (stitched corner -> panorama pixel):']) AS text, unnest(range(9)) AS line FROM p, c),
heads AS (SELECT k, unnest(['Individual-ROIs to Panorama Mapping', repeat('=', 40), '']) AS text, unnest(range(3)) AS line FROM p),
abouts AS (SELECT k, sel_ord, unnest(['--- ' || trim(s.description) || ' ---', '  Dimensions: ' || w || 'x' || h || ' px', format('  Pixel size: {{:.4f}} x {{:.4f}} um', s.px, s.px / 2), '  Corners (panorama px):']) AS text, unnest(range(4)) AS line FROM sel s, p),
many AS (SELECT sel_ord, least(4, count(*)) AS n FROM sel JOIN corners USING (roi_id) GROUP BY 1)
SELECT k::BIGINT AS flat_ix, 0::BIGINT AS section, 0::BIGINT AS block, line::BIGINT AS line, text FROM tops
UNION ALL SELECT k, 0, 0, 8 + i, format('  {{}}: {{:.3f}}, {{:.3f}}', {_CORNER.format(i="i")}, (cx - x1) * (side / (x2 - x1)), (y2 - cy) * (side / (y2 - y1))) FROM ends
UNION ALL SELECT k, 0, 0, 13, '' FROM p
UNION ALL SELECT k, 1, 0, line, text FROM heads
UNION ALL SELECT k, 2, -sel_ord, line, text FROM abouts
UNION ALL SELECT k, 2, -sel_ord, 4 + pos, format('    {{}}: {{:.1f}}, {{:.1f}}', {_CORNER.format(i="(pos + 1)::INT")}, px, py) FROM spots
UNION ALL SELECT k, 2, -sel_ord, 4 + n, '' FROM many, p"""
)
def q_roi_map(spark, sf_dir):
    """The map files of two panoramas, with the stitched canvas and every region, line by line."""
    rois = catalog.select_rois(_rois_df(spark, sf_dir, True), SELECTION).withColumn("px_y", F.col("px_y") / 2)  # the map's pitch is the one over x
    panoramas = geometry.panorama_bounds(catalog.flatten_panoramas(B.panoramas(spark, sf_dir)).where("flat_ix in (0, 3)"))
    return longs(reports.roi_map_lines(panoramas, rois, reports.map_canvas(rois)).select("flat_ix", "section", "block", "line", "text"), "flat_ix", "section", "block", "line")


@query(
    f"""WITH {_rois()}, {_selection(SELECTED)}, {_PANOS}, shown AS (SELECT *, CASE WHEN roi_id % 3 = 0 THEN NULL ELSE ' ' || description || repeat(' long', roi_id) || ' ' END AS d, CASE WHEN roi_id % 4 = 0 THEN NULL WHEN roi_id % 4 = 1 THEN 'soon' ELSE '2024-03-0' || (roi_id % 9 + 1) || 'T10:00:00.1234567+02:00' END AS raw FROM sel)
SELECT 0::BIGINT AS section, 0::BIGINT AS block, line::BIGINT AS line, text FROM {_fixed("''", "'  MCD FILE: slide'")}
UNION ALL SELECT 1, -1, line, text FROM {_fixed("''", "'  PANORAMAS:'")}
UNION ALL SELECT 1, k, 0, '    ' || k || ': slide ' || k || ', pano 0: ' || CASE WHEN k = 2 THEN 'N/A' ELSE description END FROM panos
UNION ALL SELECT 2, 0, 0, ''
UNION ALL SELECT 3, -1, line, text FROM {_fixed("'  ROI TABLE:'", "'    Idx  | ' || rpad('Description', 35, ' ') || ' | ' || rpad('Timestamp', 19, ' ') || ' | Size (WxH)  '", "'    ' || repeat('-', 4) || '-+-' || repeat('-', 35) || '-+-' || repeat('-', 19) || '-+-' || repeat('-', 12)")}
UNION ALL SELECT 3, sel_ord, 0, '    ' || rpad(sel_ord::VARCHAR, 4, ' ') || ' | ' || rpad(CASE WHEN length(trim(coalesce(d, ''))) > 35 THEN substr(trim(d), 1, 32) || '...' ELSE trim(coalesce(d, '')) END, 35, ' ') || ' | ' || rpad(CASE WHEN raw IS NULL THEN '' WHEN raw = 'soon' THEN raw ELSE substr(raw, 1, 10) || ' 10:00:00' END, 19, ' ') || ' |   40x30  ' FROM shown
UNION ALL SELECT 4, 0, line, text FROM {_fixed("' '", "' CHANNELS (2): CH0, CH1 '", "''")}"""
)
def q_summary(spark, sf_dir):
    """The metadata summary, line by line."""
    r = F.col("roi_id")
    d = F.when(r % 3 != 0, F.concat(F.lit(" "), "description", F.repeat(F.lit(" long"), r), F.lit(" ")))
    raw = F.when(r % 4 == 1, "soon").when(r % 4 != 0, F.concat(F.lit("2024-03-0"), (r % 9 + 1).cast("string"), F.lit("T10:00:00.1234567+02:00")))
    rois = catalog.select_rois(_rois_df(spark, sf_dir), SELECTION).withColumns({"description": d, "start_ts_raw": raw})
    panoramas = catalog.flatten_panoramas(B.panoramas(spark, sf_dir)).withColumn("description", F.when(F.col("slide_ix") != 2, F.col("description")))
    return longs(reports.summary_lines("slide", rois, ["CH0", "CH1"], panoramas).select("section", "block", "line", "text"), "section", "block", "line")


@query(
    """WITH two AS (SELECT r_regionkey AS slide_ix, p AS pano_ix, r_name || '/' || p AS description FROM region, (VALUES (0), (1)) AS t(p) WHERE r_regionkey <> 3 OR p = 0),
flat AS (SELECT *, row_number() OVER (ORDER BY slide_ix, pano_ix) - 1 AS flat_ix FROM two)
SELECT flat_ix, slide_ix::BIGINT AS slide_ix, pano_ix::BIGINT AS pano_ix, description FROM flat WHERE flat_ix IN (1, 2, 3, 7)"""
)
def q_pano_several(spark, sf_dir):
    """Two panoramas a slide, one of them missing."""
    d = B.panoramas(spark, sf_dir).drop("pano_ix").withColumn("pano_ix", F.explode(F.array(F.lit(1), F.lit(0)))).where("slide_ix != 3 or pano_ix = 0")
    d = d.withColumn("description", F.concat("description", F.lit("/"), F.col("pano_ix").cast("string")))
    return longs(catalog.select_panoramas(catalog.flatten_panoramas(d), "3,1-2,7,30").select("flat_ix", "slide_ix", "pano_ix", "description"), "flat_ix", "slide_ix", "pano_ix")


def _shared_folder(spark) -> str:
    """A folder that driver and executors see: the one in spark.checkpoint.dir, a temporary one where that is unset."""
    import tempfile

    path = spark.conf.get("spark.checkpoint.dir", None)
    return path.removeprefix("file://") if path else tempfile.mkdtemp(prefix="segments-")


def _segment_file(spark, sf_dir: str) -> tuple[str, list[dict]]:
    """A raw file of three segments whose values come from the region table, one with a cut last record."""
    import os
    import uuid

    import numpy as np

    n = B.table(spark, sf_dir, "region").count()
    folder = _shared_folder(spark)
    os.makedirs(folder, exist_ok=True)
    path, at, segments = f"{folder}/segments-{uuid.uuid4().hex}.mcd", 0, []
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(gone)
    with open(path, "wb") as f:
        for roi, (width, kind) in enumerate(((4, "<f4"), (8, "<f8"), (2, "<f2"))):
            i = np.arange(20 * n)
            data = np.stack([i % 7, i // 7, 0 * i, i, 2 * i], axis=1).astype(kind).tobytes() + b"x" * (roi == 2)
            f.write(data)
            segments.append({"roi_id": roi, "data_start": at, "data_end": at + len(data), "value_bytes": width, "num_channels": 2, "name": f"roi{roi}"})
            at += len(data)
    return path, segments


@query(
    """WITH i AS (SELECT unnest(range(20 * (SELECT count(*) FROM region))) AS i), k AS (SELECT unnest(range(3)) AS roi_id), c AS (SELECT unnest(range(2)) AS ch)
SELECT roi_id, ch, i // 7 AS y, i % 7 AS x, ((ch + 1) * i)::DOUBLE AS v FROM i, k, c"""
)
def q_segment_scan(spark, sf_dir):
    from pixelloom.sources.segments import read_segments_safely

    path, segments = _segment_file(spark, sf_dir)
    records, _ = read_segments_safely(spark, path, segments)
    return longs(mosaic.scatter(mosaic.unpivot(records).withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})), "roi_id", "ch", "y", "x")


@query(
    """WITH seg AS (SELECT s_suppkey AS seg_id, (s_suppkey % 8 + 1)::BIGINT AS c, CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 3 END::BIGINT AS vb, (s_suppkey * 13)::BIGINT AS a, (s_suppkey * 13 + (s_suppkey % 50) * (s_suppkey % 8 + 4) * 8 + s_suppkey % 3)::BIGINT AS b, (s_suppkey * 13 + CASE WHEN s_suppkey % 5 = 0 THEN 100 ELSE 10000 END)::BIGINT AS f FROM supplier),
n AS (SELECT *, (c + 3) * vb AS stride, greatest(a, least(b, f)) AS e, vb NOT IN (2, 4, 8) AS odd, b > f AS cut FROM seg)
SELECT seg_id, CASE WHEN odd THEN 'skipped' WHEN cut OR (e - a) % stride <> 0 THEN 'recovered' ELSE 'ok' END AS status, CASE WHEN odd THEN 0 ELSE (e - a) // stride END::BIGINT AS n_records,
 CASE WHEN odd THEN 'values of ' || vb || ' bytes are not supported' WHEN cut THEN 'the file ends before the segment' WHEN (e - a) % stride <> 0 THEN 'the segment ends within a record' END AS message FROM n"""
)
def q_error_isolation(spark, sf_dir):
    """Status and message of each of many segments; a bad one does not end the others."""
    s = F.col("s_suppkey")
    seg = B.table(spark, sf_dir, "supplier").select(
        s.alias("seg_id"), (s % 8 + 1).alias("num_channels"), F.when(s % 4 == 0, 2).when(s % 4 == 1, 4).when(s % 4 == 2, 8).otherwise(3).alias("value_bytes"), (s * 13).alias("data_start"),
        (s * 13 + (s % 50) * (s % 8 + 4) * 8 + s % 3).alias("data_end"), (s * 13 + F.when(s % 5 == 0, 100).otherwise(10_000)).alias("file_size"),
    )
    return mosaic.isolate(seg).select("seg_id", "status", "n_records", "message")
