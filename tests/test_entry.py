import duckdb
import pytest

import __spark_entry__ as entry
from pixelflow.plans import oracle
from pixelflow.plans import queries as detector

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).columns == ["bin", "lo", "hi", "center", "count"]


@pytest.mark.parametrize("name", ["decode_pixel_address", "decode_trigger", "correlate_live", "correlate_offline", "tof_histogram", "roi_images", "timeseries_compat", "run_status", "density_labels", "centroids_weighted"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = detector.queries()[name](spark, SF)
    result = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(result.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
