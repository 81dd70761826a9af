"""Every query with an oracle agrees with DuckDB; the others give rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from chorale.plans import catalog
from chorale.sources import tables
from oracle import connect, same

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


#: At the smallest scale many bins and cells are empty.
SPARSE = ["block_rms_stream", "frames", "full_blocks", "psd_multitaper", "safe_avg_power", "safe_corrcoef", "safe_slice", "semivariogram", "spatial_autocov"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    assert same(connect(MID), catalog.ORACLES[name], catalog.QUERIES[name](spark, MID)) == []


@pytest.mark.parametrize("name", SPARSE)
def test_oracle_with_gaps(spark, name):
    assert same(connect(SMALL), catalog.ORACLES[name], catalog.QUERIES[name](spark, SMALL)) == []


@pytest.mark.parametrize("name", ["full_blocks", "bootstrap_mean", "band_power", "frame_clim"])
def test_oracle_on_events_of_another_span(spark, name, tmp_path):
    """Events of other months, over more days: every one falls into a bin."""
    for t in ("events", "nation"):
        x = spark.read.parquet(f"{SMALL}/{t}.parquet")
        if t == "events":
            x = x.withColumn("ts", F.expr("timestampadd(MICROSECOND, timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) * 2, timestamp_ntz'2023-08-19 05:00:00')"))
        x.write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert same(con, catalog.ORACLES[name], got) == []
    one = tables.span(spark, str(tmp_path)).first()
    assert one.width == 2 * tables.BIN_US or one.width == 3 * tables.BIN_US
    assert tables.samples(spark, str(tmp_path)).where("x != 0").count() > 300


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, MID).count() > 0


def test_entry_tolerates_missing_parts(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert entry._optional("chorale.no_such_part") is None
