"""Results to storage: layers, CSV, graph exchange, backups, and digests of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bronze import hashed


def write_layer(df: DataFrame, path: str, *, partition: str | None = "caso", replace: bool = True) -> None:
    """A Parquet layer partitioned by case; with ``replace`` only the partitions present in ``df`` are replaced (delete and insert in one commit)."""
    w = df.write.mode("overwrite" if replace else "append")
    if partition:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, *, order: list[str], single: bool = True) -> None:
    """Sorted CSV with header; one file for results of report size."""
    out = df.coalesce(1).sortWithinPartitions(*order) if single else df.orderBy(*order)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Published edges (Source, Target, Weight, Timestamp) and nodes (Id, ...) as CSV for graph tools."""
    e = edges.select(F.col("source").alias("Source"), F.col("target").alias("Target"), F.col("weight").alias("Weight"), F.col("data").alias("Timestamp"), "caso", "stance_origem")
    write_csv(e, f"{path}/arestas", order=["caso", "Timestamp", "Source", "Target"], single=False)
    write_csv(nodes.withColumnRenamed("id", "Id"), f"{path}/nos", order=["caso", "Id"], single=False)


def backup(spark: SparkSession, source: str, target: str) -> int:
    """A copy of a Parquet table, checked by its count."""
    spark.read.parquet(source).write.mode("errorifexists").parquet(target)
    a, b = spark.read.parquet(source).count(), spark.read.parquet(target).count()
    if a != b:
        raise RuntimeError(f"backup has {b} of {a} rows")
    return b


def folder_digest(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """arquivo (path below the folder), sha256 of every file's bytes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath()
    below = F.regexp_replace(F.url_decode(F.replace(F.col("uri"), F.lit("+"), F.lit("%2B"))), rf"^.*?\Q{root.rstrip('/')}/\E", "")
    return hashed(spark, folder, glob).select(below.alias("arquivo"), "sha256")


def compare_folders(spark: SparkSession, a: str, b: str, glob: str = "*.csv") -> DataFrame:
    """Files that differ or are in one folder alone; empty if all bytes are equal."""
    x, y = folder_digest(spark, a, glob).withColumnRenamed("sha256", "a"), folder_digest(spark, b, glob).withColumnRenamed("sha256", "b")
    return x.join(y, "arquivo", "full").where(~F.col("a").eqNullSafe(F.col("b")))
