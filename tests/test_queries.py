import math

import duckdb
import numpy as np
import pytest

from rasterweave import queries
from rasterweave.functions import catalog, scalars

SF = "/root/testdata/sf0.001"
NEW = ("log_ci95", "log_reindex", "bmp_bands_bb", "images_same_name", "compose_normal", "conv_gb_truncate", "conv_gb_truncate_tile", "conv_gb_truncate_separable", "conv_em_truncate_rowarray", "header_and_byte_diff", "queue_log_roundtrip", "synthetic_images")


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "lineitem"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str) and got


def test_intervals_of_every_user(spark):
    """Every user of events has a group, and the SQL keeps none out."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    users = {r[0] for r in con.execute("select distinct user_id from events where event_type is not null and value is not null").fetchall()}
    assert {r["user_id"] for r in queries.queries()["log_ci95"](spark, SF).collect()} == users
    assert {r[1] for r in con.execute(queries.oracle_sql()["log_ci95"]).fetchall()} == users


def test_t_quantiles():
    """Closed forms for 1, 2 and 4 degrees of freedom, tables for others, and the expansion beyond the table."""
    assert abs(scalars.t_975(1) - math.tan(0.475 * math.pi)) < 1e-9
    assert abs(scalars.t_975(2) - 0.95 / math.sqrt(2 * 0.975 * 0.025)) < 1e-9
    for df, value in ((31, 2.039513), (40, 2.021075), (60, 2.000298), (120, 1.979930)):
        assert abs(scalars.t_975(df) - value) < 1e-6
        assert abs(scalars.t_975(df) - queries._t_by_integration(df)) < 1e-9


def test_beyond_the_table(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(n,) for n in (200, 201, 500, 5000)], "n long").select("n", scalars.t_quantile(F.col("n")).alias("t")).collect()
    assert all(abs(r["t"] - scalars.t_975(r["n"])) < 1e-9 for r in rows)


def test_gaussian_tables_are_symmetric():
    for taps in (np.array(catalog.LARGE_GAUSS), np.array(catalog.MEDIUM_GAUSS)):
        assert (taps == taps[::-1]).all() and (taps == taps[:, ::-1]).all() and (taps == taps.T).all()
