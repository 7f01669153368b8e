"""Queries over small tables of their own, held against their SQL."""

import duckdb
import pytest
from test_queries import rows

from trussline.operators import packing
from trussline.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def given(spark, tmp_path):
    """Writes tables as Parquet and gives (rows of a query, rows of its SQL) over them."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df, rel = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
        return rows(df.columns, df.collect()), rows(list(rel.columns), rel.fetchall())

    return run


def test_assets_have_the_bounds_of_their_sql(spark, given):
    orders = spark.createDataFrame([(k, k % 2, "1-URGENT", 10.5 * k) for k in range(200, 240)], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double")
    got, want = given("supermesh_assets", orders=orders)
    assert got == want and len(got) == 2


def _lines(spark):
    """Lines of two parts whose suppliers' numbers are those of other corners of the same face."""
    k = range(1, 60)
    return spark.createDataFrame([(i, 1 + i % 2, 1 + i % 7, (100 + i % 13) if i % 3 else 201 + i % 7) for i in k], "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long")


def test_runs_of_faces_that_name_a_vertex_twice(spark, given):
    got, want = given("mesh_split_runs", lineitem=_lines(spark))
    assert got == want and len(got) == 59
    faces = spark.createDataFrame([(1, 1, [5, 6, 5]), (1, 2, [6, 7, 8])], "mesh long, face long, vertices array<long>")
    runs = packing.split_runs(faces, 24, 20)
    assert [(r.face, r.local, r.used) for r in runs.orderBy("face").collect()] == [(1, [0, 1, 0], 3), (2, [1, 3, 4], 5)]
    assert packing.pieces_of(runs.where("face = 1")).first().vertices == 3


def test_map_of_pieces_that_name_a_vertex_twice(spark, given):
    part = spark.createDataFrame([(1, "B", 50), (2, "B", 49), (3, "B", 7)], "p_partkey long, p_brand string, p_size int")
    got, want = given("mesh_rechunk_map", lineitem=_lines(spark), part=part)
    assert got == want and got


def test_drop_takes_the_customers_of_all_orders(spark, given):
    customer = spark.createDataFrame([(k, f"c{k}", 1, "a", "BUILDING", "1", 0.0, "") for k in (1, 2, 3)], "c_custkey long, c_name string, c_nationkey int, c_address string, c_mktsegment string, c_phone string, c_acctbal double, c_comment string")
    orders = spark.createDataFrame([(1, 1, "P"), (2, 2, "F")], "o_orderkey long, o_custkey long, o_orderstatus string")
    got, want = given("drop_documents", customer=customer, orders=orders)
    assert got == want == [(3, "c3")]
