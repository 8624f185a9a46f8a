"""Study outputs, checkpoints and checks of stored files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(tables: list[DataFrame], path: str) -> None:
    """One table with the columns of all, missing ones empty."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def signature(*columns: Column) -> Column:
    """What a stored result depends on, as one digest."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def append_checkpoint(rows: DataFrame, path: str, mark: str) -> None:
    """Add results to a checkpoint under the signature of the run that made them."""
    rows.withColumn("signature", F.lit(mark)).write.mode("append").partitionBy("signature").parquet(path)


def resume(jobs: DataFrame, stored: DataFrame, mark: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows of the same signature, once each, and the jobs that still have to run."""
    done = stored.where(F.col("signature") == mark).dropDuplicates([key])
    return done, jobs.join(done.select(key), key, "left_anti")


def verify_files(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """name, ok, problem: size and SHA-256 of each file that ``manifest`` (name, bytes, sha256) lists."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("digest"))
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("digest") != F.col("sha256"), "digest")
    return manifest.join(found, "name", "left").select("name", problem.isNull().alias("ok"), problem.alias("problem"))


def validation_plans(split: DataFrame, *, key: str, place: str, n: int) -> DataFrame:
    """The first ``n`` validation rows of each key, in the order of the file."""
    from pyspark.sql import Window

    return split.where("split = 'validation'").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(place))).where(F.col("_r") <= n).drop("_r")


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one JSON object of a file; no row where there is no file or no object."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_materials(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Materials of a packed file (table materials), a Parquet folder, or lines of JSON, told apart by the ending."""
    from roomlake.sources import sqlite

    if path.endswith((".sqlite", ".db")):
        return sqlite.read_table(spark, path, "materials")
    return read_jsonl(spark, path, schema) if path.endswith((".jsonl", ".json")) else spark.read.schema(schema).parquet(path)
