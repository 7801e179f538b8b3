"""Every registered query of the raster engine against its SQL."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from pixelloom.plans import bindings, queries
from tests.compare import database, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.SQL:
        assert difference(con, df, queries.SQL[name]) == ""
    else:
        assert df.count() >= 0


def test_every_region_is_densified(spark):
    n = queries.QUERIES["q_densify"](spark, SF).groupBy("roi_id").count().collect()
    assert {r.roi_id for r in n} == {r.n_nationkey for r in spark.read.parquet(f"{SF}/nation.parquet").collect()} and {r["count"] for r in n} == {7 * 30 * 40}


#: Queries over records. ``shifted`` has ordinals that no bigint holds, so the SQL overflows unless they are widened.
BY_ORDINAL = ["q_bounds_filter", "q_bounds_odd", "q_densify", "q_mosaic_f32", "q_mosaic_selected", "q_mosaic_u16", "q_record_scatter", "q_resample", "q_tiling"]


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """Line items followed by two copies with large keys; in the last, lower order keys have the higher ordinals, by their part keys."""
    at = tmp_path_factory.mktemp("shifted")
    for name in ("nation", "supplier"):
        shutil.copy(f"{SF}/{name}.parquet", at)
    copies = "VALUES (0, 0, 0), (9300000, 0, 0), (9299690, 42000000, 1)"
    duckdb.sql(f"COPY (SELECT l.* REPLACE (l_orderkey + o AS l_orderkey, l_partkey + p AS l_partkey, l_extendedprice + e AS l_extendedprice) FROM read_parquet('{SF}/lineitem.parquet') l, ({copies}) AS c(o, p, e)) TO '{at}/lineitem.parquet'")
    return str(at)


@pytest.mark.parametrize("name", BY_ORDINAL)
def test_ordinals_beyond_a_bigint(spark, shifted, name):
    df = queries.QUERIES[name](spark, shifted)
    if "rec_ord" in df.columns:
        assert dict(df.dtypes)["rec_ord"] == "decimal(38,0)" and dict(queries.QUERIES[name](spark, SF).dtypes)["rec_ord"] == "bigint"
        df = df.withColumn("rec_ord", F.col("rec_ord").cast("string"))
    wide = queries.SQL[name].replace("10000000000000", "10000000000000::HUGEINT").replace("rec_ord::BIGINT", "rec_ord::VARCHAR")
    assert difference(database(shifted), df, wide) == ""


@pytest.mark.parametrize(("order", "part", "kind"), [(922336, 10**5, "bigint"), (922337, 2036, "bigint"), (922337, 203685477, "decimal(38,0)"), (-922338, 0, "decimal(38,0)"), (1, 2**62, "decimal(38,0)"), (None, 5, "bigint")])
def test_ordinal_is_a_bigint_while_it_fits(spark, order, part, kind):
    items = spark.createDataFrame([(order, part, 7.25), (3, 4, 1.5)], "l_orderkey long, l_partkey long, l_extendedprice double")
    df = items.select(bindings.ordinal(items).alias("o"))
    want = {None if order is None else str(order * 10**13 + part * 10**8 + 725), str(3 * 10**13 + 4 * 10**8 + 150)}
    assert dict(df.dtypes)["o"] == kind and {r[0] for r in df.select(F.col("o").cast("string")).collect()} == want
