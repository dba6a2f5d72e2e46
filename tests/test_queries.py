"""Every registered query of the library against its SQL, and its independence of partitioning."""

import duckdb
import pytest
from oracle import connection, differences

from sparkloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["agg_group_by", "join_many_groups", "win_row_number", "topk", "range_count_over_time", "unnest_group"])
@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, sf, con, name, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert differences(QUERIES[name](spark, sf), SQL[name], con) == ""
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, sf):
    from sparkloom.operators.reports import plan, pushed_filters

    df = QUERIES["scan_pruned_count"](spark, sf)
    assert any("o_orderkey" in f for f in pushed_filters(df))
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan(df)


def test_sketches_are_kept_for_groups_not_for_distinct_values(spark, sf):
    from sparkloom.operators.reports import plan

    steps = [s for s in plan(QUERIES["agg_approx_error"](spark, sf)).split("\n\n") if "approx_count_distinct(l_orderkey" in s and "Keys [" in s]
    keys = [line for s in steps for line in s.splitlines() if line.startswith("Keys [")]
    assert keys and not any("l_orderkey" in k for k in keys), keys


def test_approximate_counts_of_null_groups_and_keys(spark, tmp_path):
    con = duckdb.connect()
    rows = "SELECT nullif(i % 4, 0) AS f, CASE WHEN i % 4 = 1 OR i % 3 = 0 THEN NULL ELSE i % 5000 END AS k FROM range(40000) t(i)"
    con.execute(f"COPY (SELECT 'flag' || f AS l_returnflag, k AS l_orderkey FROM ({rows})) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert differences(QUERIES["agg_approx_error"](spark, str(tmp_path)), SQL["agg_approx_error"], con) == ""
    con.execute(f"COPY (SELECT * FROM lineitem LIMIT 0) TO '{tmp_path}/none.parquet' (FORMAT parquet)")
    (tmp_path / "none.parquet").replace(tmp_path / "lineitem.parquet")
    assert QUERIES["agg_approx_error"](spark, str(tmp_path)).collect() == []
