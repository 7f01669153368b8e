"""Stored files and the references that name them: upload, delete, look-up, and a sweep of what nothing names.

References are rows (_id, link, type, size, metadata, version, deleted), only ever added: the row of the highest version of an
_id counts, and one that is `deleted` is a tombstone.  Files are named by a link of their own, never by _id, so a re-upload
never overwrites what a reader has open.  A file is written before its reference and removed after its tombstone: a crash
between the steps leaves a file that nothing names, never a reference without a file, and `sweep` removes such files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import materialize

FS = "fs"
REFERENCE = "_id string, link string, type string, size long, metadata map<string,string>, version long, deleted boolean"


def references(spark: SparkSession, path: str) -> DataFrame:
    """The references of a store at `path` that count."""
    return current(_read(spark, f"{path}/refs", REFERENCE))


def current(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c != "_id"]
    newest = rows.groupBy("_id").agg(F.max_by(F.struct(*names), F.struct("version", "link")).alias("r"))
    return newest.where("not r.deleted").select("_id", *(F.col(f"r.{c}").alias(c) for c in names))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _version(spark: SparkSession, path: str) -> int:
    return (_read(spark, f"{path}/refs", REFERENCE).agg(F.max("version")).first()[0] or 0) + 1


def put(files: DataFrame, path: str) -> DataFrame:
    """First step of an upload: writes the bytes of `files` (_id, content, metadata) and returns their references, not yet told."""
    spark = files.sparkSession
    version = _version(spark, path)
    # the link depends on what is uploaded and when, so a task that runs again writes the same rows
    link = F.concat_ws("-", F.lit(str(version)), F.substring(F.sha2(F.concat(F.col("_id"), F.lit("\0")), 256), 1, 16), F.substring(F.sha2("content", 256), 1, 16))
    rows = materialize(files.select("_id", link.alias("link"), "content", "metadata"))
    rows.select("link", "content").write.mode("append").parquet(f"{path}/files")
    return rows.select("_id", "link", F.lit(FS).alias("type"), F.octet_length("content").cast("long").alias("size"), "metadata", F.lit(version).cast("long").alias("version"), F.lit(False).alias("deleted"))


def tell(refs: DataFrame, path: str) -> None:
    """Second step: the references count from here on."""
    refs.write.mode("append").parquet(f"{path}/refs")


def upload(files: DataFrame, path: str) -> None:
    """Stores `files` (_id, content binary, metadata map) and their references; of an _id that is there the new one counts."""
    tell(put(files, path), path)


def delete(ids: DataFrame, path: str) -> DataFrame:
    """Takes the references of `ids` (_id) out; returns (_id, found): one that no reference has is not found, and nothing is done for it.

    The bytes go with the next `sweep`.
    """
    spark = ids.sparkSession
    known = references(spark, path)
    asked = materialize(ids.select(F.col("_id").alias("_want")).distinct().join(known, F.col("_want") == F.col("_id"), "left"))
    gone = asked.where("_id is not null").select("_id", "link", "type", F.lit(0).cast("long").alias("size"), "metadata", F.lit(_version(spark, path)).cast("long").alias("version"), F.lit(True).alias("deleted"))
    tell(gone, path)
    return asked.select(F.col("_want").alias("_id"), F.col("_id").isNotNull().alias("found"))


def load(ids: DataFrame, path: str) -> DataFrame:
    """(_id, content, size, metadata) of `ids`; a reference without its file raises, an _id without reference has no row."""
    spark = ids.sparkSession
    named = references(spark, path).join(ids.select("_id").distinct(), "_id")
    files = _read(spark, f"{path}/files", "link string, content binary").select(F.col("link").alias("_link"), "content").dropDuplicates(["_link"])
    found = named.join(files, named["link"] == files["_link"], "left")
    lost: Column = F.raise_error(F.concat(F.lit("no file for reference "), F.col("_id"))).cast(T.BinaryType())
    return found.select("_id", F.when(F.col("_link").isNull(), lost).otherwise(F.col("content")).alias("content"), "size", "metadata")


def unreferenced(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(link): stored files that no counting reference names, of versions before `before` (an upload under way has none yet)."""
    links = _read(spark, f"{path}/files", "link string, content binary").select("link").distinct()
    old = F.lit(True) if before is None else F.substring_index("link", "-", 1).cast("long") < before
    return links.where(old).join(references(spark, path).select("link"), "link", "left_anti")


def sweep(spark: SparkSession, path: str, before: int | None = None) -> int:
    """Rewrites the stored files without those that nothing names, next to the old ones, and then puts it in their place; returns how many went.

    A crash while the new files are written leaves the old ones as they are.  Run it when no upload is between its steps, or
    with `before`, the version of the oldest that is.
    """
    gone = materialize(unreferenced(spark, path, before))
    n = gone.count()
    if n:
        _read(spark, f"{path}/files", "link string, content binary").join(gone, "link", "left_anti").write.mode("overwrite").parquet(f"{path}/files-new")
        paths = {name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in ("files", "files-new", "files-old")}
        fs = paths["files"].getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(paths["files-old"], True)
        fs.rename(paths["files"], paths["files-old"])
        fs.rename(paths["files-new"], paths["files"])
        fs.delete(paths["files-old"], True)
    return n


def recover(spark: SparkSession, path: str) -> None:
    """Finishes a sweep that ended between its two renames."""
    paths = {name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in ("files", "files-new", "files-old")}
    fs = paths["files"].getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(paths["files"]):
        fs.rename(paths["files-new"] if fs.exists(paths["files-new"]) else paths["files-old"], paths["files"])
    fs.delete(paths["files-old"], True)
    fs.delete(paths["files-new"], True)
