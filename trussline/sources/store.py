"""Collections of documents as DataFrames: finds, pages, counts and write operations.

Reads return lazy DataFrames.  Writes are transforms from the collection and a change to the new
collection (joins on `_id`), and `Store` persists them as tables of the catalog.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.filters import Filter, Projection, condition, project
from ..plans.scratch import materialize

def find_all(df: DataFrame, q: Filter | None, projection: Projection | None = None) -> DataFrame:
    """Matching rows; an empty filter matches nothing."""
    c = condition(q, df)
    return project(df.where(F.lit(False) if c is None else c), projection)


def find_cursor(df: DataFrame, q: Filter | None, projection: Projection | None = None) -> DataFrame:
    """As `find_all`, to be streamed with toLocalIterator; an empty filter is an error."""
    if condition(q, df) is None:
        raise ValueError("a cursor needs a filter")
    return find_all(df, q, projection)


def find_one(df: DataFrame, q: Filter, sort: str | None = None, tie: str = "_id") -> DataFrame:
    """The first matching row by `sort` descending."""
    hit = find_all(df, q)
    ties = [F.col(tie)] if tie in df.columns else []
    return (hit.orderBy(F.desc(sort), *ties) if sort else hit).limit(1)


def page(df: DataFrame, sort: str | None = None, ascending: bool = False, skip: int = 0, limit: int = 0, fields: Iterable[str] = (), tie: str = "_id") -> DataFrame:
    """Sorted page of a whole collection; limit 0 is none; `_id` is always kept."""
    if sort:
        ties = [F.col(tie)] if tie in df.columns and tie != sort else []
        df = df.orderBy(F.asc(sort) if ascending else F.desc(sort), *ties)
    if skip:
        df = df.offset(skip)
    if limit:
        df = df.limit(limit)
    return project(df, Projection(include=tuple(fields)) if fields else None)


def count(df: DataFrame, q: Filter | None = None, name: str = "n") -> DataFrame:
    """One row with the number of matching rows; an empty filter counts all."""
    c = condition(q, df)
    return (df if c is None else df.where(c)).agg(F.count("*").alias(name))


def collection_prefix(namespace: Column, extension: str) -> Column:
    """The part before `.extension`."""
    return F.regexp_extract(namespace, rf"^(.*)\.{extension}$", 1)


def upsert_replace(df: DataFrame, change: DataFrame, key: str = "_id") -> DataFrame:
    """Rows of `change` replace those of the same key and are added otherwise."""
    return df.join(change.select(key), key, "left_anti").unionByName(change, allowMissingColumns=True)


def upsert_merge(df: DataFrame, change: DataFrame, key: str = "_id") -> DataFrame:
    """Fields that `change` gives are set, others stay; unknown keys are added."""
    new = change.withColumnsRenamed({c: f"_new_{c}" for c in change.columns})
    both = df.join(new, df[key] == new[f"_new_{key}"], "full_outer")
    columns = [*df.columns, *(c for c in change.columns if c not in df.columns)]

    def merged(c: str) -> Column:
        given, old = f"_new_{c}" in new.columns, c in df.columns
        return (F.coalesce(F.col(f"_new_{c}"), F.col(c)) if given and old else F.col(f"_new_{c}") if given else F.col(c)).alias(c)

    return both.select(*map(merged, columns))


def add_parents(df: DataFrame, change: DataFrame, key: str = "_id") -> DataFrame:
    """Set-adds `change.parents` to the parents of existing rows; unknown keys add nothing."""
    new = change.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("parents"))).alias("_add"))
    none = F.array().cast("array<string>")
    return df.join(new, key, "left").withColumn("parents", F.when(F.col("_add").isNull(), F.col("parents")).otherwise(F.array_union(F.coalesce("parents", none), "_add"))).select(*df.columns)


def drop_documents(df: DataFrame, ids: DataFrame, key: str = "_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


class Store:
    """Collections as tables of the session's catalog: database `database`, table `collection` (dots are `__`).

    Tables are Parquet, in `root` if it is given.  What a write reads and writes at once is first written to a scratch
    table.  A catalog of transactional tables gives the same calls isolation between writers.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root and root.rstrip("/")

    def name(self, database: str, collection: str) -> str:
        return f"`{database}`.`{collection.replace('.', '__')}`"

    def exists(self, database: str, collection: str) -> bool:
        return self.spark.catalog.databaseExists(database) and self.spark.catalog.tableExists(self.name(database, collection))

    def read(self, database: str, collection: str) -> DataFrame:
        if not self.exists(database, collection):
            raise FileNotFoundError(f"{database}.{collection}")
        return self.spark.table(self.name(database, collection))

    def _write(self, database: str, collection: str, df: DataFrame, mode: str) -> None:
        at = f" LOCATION '{self.root}/{database}'" if self.root else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{at}")
        df.write.mode(mode).saveAsTable(self.name(database, collection))

    def insert(self, database: str, collection: str, df: DataFrame) -> None:
        """Appends."""
        self._write(database, collection, df, "append")

    def replace(self, database: str, collection: str, df: DataFrame) -> None:
        """The table's new rows, which may come from its old ones."""
        self._write(database, collection, materialize(df), "overwrite")

    def upsert(self, database: str, collection: str, change: DataFrame, overwrite: bool) -> None:
        if not self.exists(database, collection):
            self.insert(database, collection, change)
            return
        old = self.read(database, collection)
        self.replace(database, collection, (upsert_replace if overwrite else upsert_merge)(old, change))

    def delete(self, database: str, collection: str, ids: DataFrame) -> None:
        self.replace(database, collection, drop_documents(self.read(database, collection), ids))

    def collections(self, database: str) -> list[str]:
        if not self.spark.catalog.databaseExists(database):
            return []
        return sorted(t.name.replace("__", ".") for t in self.spark.catalog.listTables(database))

    def drop(self, database: str, collection: str) -> bool:
        there = self.exists(database, collection)
        if there:
            self.spark.sql(f"DROP TABLE {self.name(database, collection)}")
        return there
