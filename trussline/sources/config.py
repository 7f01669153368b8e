"""Engine settings from a JSON file: where documents and files live, and how jobs are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    database: str
    files: str
    file_levels: int = 2
    gzip_files: bool = True


def read_settings(spark: SparkSession, path: str) -> Settings:
    """The file is read by Spark, so it may be in any store; a missing section is an error."""
    row = spark.read.schema("db struct<root:string>, fs struct<path:string,level:int,gzip:boolean>").json(path, multiLine=True).first()
    if row is None or row.db is None or row.fs is None:
        raise ValueError("settings need the sections db and fs")
    return Settings(row.db.root, row.fs.path, 2 if row.fs.level is None else row.fs.level, True if row.fs.gzip is None else row.fs.gzip)
