"""Finds, pages, counts and write operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.filters import ElemMatch, Eq, Exists, Projection, all_of, any_of, project
from ..sources import store
from .scene import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def find_eq(spark, sf):
    return store.find_all(table(spark, sf, "orders"), Eq("o_orderstatus", "F")).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def find_in(spark, sf):
    return store.find_all(table(spark, sf, "orders"), Eq("o_orderpriority", ["1-URGENT", "2-HIGH"])).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE CASE WHEN c_acctbal >= 0 THEN c_acctbal END IS NULL")
def find_exists(spark, sf):
    df = table(spark, sf, "customer").withColumn("credit", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return store.find_all(df, Exists("credit", False)).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderpriority = '1-URGENT' AND o_custkey IN (1, 2, 3))")
def find_or(spark, sf):
    q = any_of(Eq("o_orderstatus", "P"), all_of(Eq("o_orderpriority", "1-URGENT"), Eq("o_custkey", [1, 2, 3])))
    return store.find_all(table(spark, sf, "orders"), q).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IS NOT NULL")
def find_and(spark, sf):
    q = all_of(Eq("o_orderstatus", ["O", "P"]), Exists("o_orderpriority"))
    return store.find_all(table(spark, sf, "orders"), q).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE false")
def find_empty_filter(spark, sf):
    return store.find_all(table(spark, sf, "orders"), Eq("o_orderstatus", [])).select("o_orderkey")


def _with_lines(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"))).alias("lines"))
    return table(spark, sf, "orders").join(lines, "o_orderkey")


@query("SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity = 10")
def find_array_contains(spark, sf):
    q = ElemMatch("lines", all_of(Eq("flag", "R"), Eq("status", "F"), Eq("quantity", 10.0)))
    return store.find_all(_with_lines(spark, sf), q).select("o_orderkey")


@query("SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 50")
def find_array_equals(spark, sf):
    """Equality on a path through an array: some element equals."""
    return store.find_all(_with_lines(spark, sf), Eq("lines.quantity", 50.0)).select("o_orderkey")


@query("SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (7, 8)")
def find_nested_field(spark, sf):
    df = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return store.find_all(df, Eq("p.k", [7, 8])).select("event_id", "user_id")


@query("SELECT c_custkey AS _id, c_name FROM customer")
def project_include(spark, sf):
    return project(table(spark, sf, "customer").withColumnRenamed("c_custkey", "_id"), Projection(include=("c_name",)))


@query("SELECT c_custkey AS _id, c_name, c_nationkey, c_mktsegment FROM customer")
def project_exclude(spark, sf):
    return project(table(spark, sf, "customer").withColumnRenamed("c_custkey", "_id"), Projection(exclude=("c_acctbal",)))


@query("SELECT o_orderkey AS _id, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def page_sorted(spark, sf):
    df = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "_id")
    return store.page(df, "o_totalprice", skip=20, limit=50, fields=["o_totalprice"])


@query("SELECT event_id AS _id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 1")
def find_one_latest(spark, sf):
    return store.find_one(table(spark, sf, "events").withColumnRenamed("event_id", "_id"), Eq("event_type", "purchase"), "ts").select("_id", "user_id")


def latest_by_branch(revisions, complete_only: bool = True, statuses: tuple = ()):
    """The newest revision of each branch: complete ones, or also those of the given statuses."""
    ok = F.col("incomplete").isNull() if complete_only else F.lit(True)
    if statuses:
        ok = ok | F.col("incomplete").isin(*statuses)
    newest = F.max_by(F.struct("_id", "timestamp"), F.struct("timestamp", "_id"))
    return revisions.where(ok).groupBy("branch").agg(newest.alias("r")).select("branch", F.col("r._id").alias("_id"), F.col("r.timestamp").alias("timestamp"))


def _revisions(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("branch"), F.col("o_orderdate").alias("timestamp"), status.alias("incomplete"))


_LATEST = "SELECT o_custkey AS branch, o_orderkey AS _id, o_orderdate AS timestamp FROM orders WHERE {} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


@query(_LATEST.format("o_orderstatus NOT IN ('O', 'P')"))
def latest_revision(spark, sf):
    return latest_by_branch(_revisions(spark, sf))


@query(_LATEST.format("o_orderstatus <> 'P'"))
def latest_revision_including_status(spark, sf):
    return latest_by_branch(_revisions(spark, sf), statuses=(1,))


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'")
def count_filtered(spark, sf):
    return store.count(table(spark, sf, "lineitem"), all_of(Eq("l_returnflag", "R"), Eq("l_linestatus", "O")))


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark, sf):
    return store.count(table(spark, sf, "lineitem"))


def _customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def _delta(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.when(F.col("c_custkey") % 2 == 0, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("_id"), F.concat(F.lit("new "), F.col("c_name")).alias("name"), F.lit(None).cast("double").alias("balance"))


_DELTA = "delta AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN -1 - c_custkey ELSE c_custkey END AS _id, 'new ' || c_name AS name FROM customer)"


@query(f"WITH {_DELTA} SELECT c_custkey AS _id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT _id FROM delta) UNION ALL SELECT _id, name, NULL FROM delta")
def upsert_replace(spark, sf):
    return store.upsert_replace(_customers(spark, sf), _delta(spark, sf))


@query(f"WITH {_DELTA} SELECT coalesce(d._id, c_custkey) AS _id, coalesce(d.name, c_name) AS name, c_acctbal AS balance FROM customer FULL OUTER JOIN delta d ON c_custkey = d._id")
def upsert_merge(spark, sf):
    return store.upsert_merge(_customers(spark, sf), _delta(spark, sf))


@query("""WITH new AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS _id, array_to_string(list_sort(list_distinct(list_concat([c_mktsegment], coalesce(p, [])))), ',') AS parents FROM customer LEFT JOIN new ON o_custkey = c_custkey""")
def add_parents(spark, sf):
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), F.array("c_mktsegment").alias("parents"))
    change = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("_id"), F.array("o_orderpriority").alias("parents"))
    return store.add_parents(nodes, change).select("_id", F.array_join(F.array_sort("parents"), ",").alias("parents"))


@query("SELECT c_custkey AS _id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def drop_documents(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("_id")).distinct()
    return store.drop_documents(_customers(spark, sf).select("_id", "name"), ids)


@query("SELECT o_orderkey AS id, regexp_extract(o_orderpriority || '.scene', '^(.*)\\.scene$', 1) AS project FROM orders")
def collection_names(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), store.collection_prefix(F.concat("o_orderpriority", F.lit(".scene")), "scene").alias("project"))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - l_quantity AS BIGINT) AS start, CAST(l_quantity AS BIGINT) AS size FROM lineitem")
def blob_ranges(spark, sf):
    """Byte ranges of values laid one after the other in an order's blob."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", before.alias("start"), F.col("l_quantity").cast("long").alias("size"))
