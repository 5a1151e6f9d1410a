"""Stored rows as tables: create-only inserts, optimistic versions, and rows without an owner."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage by a table in the cluster's shared folder (one of our own only under a local master, where none is set)."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="echolens-")
        spark.sparkContext.setCheckpointDir(found)
    path = f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, by: str, name: str, first: int = 1) -> DataFrame:
    """Adds gap-free numbers in the global order of the unique ``by``, without one task seeing all rows: rows are dealt out by
    ranges, counted by range (one number for each comes to the driver), and numbered within their range."""
    ranged = kept(rows.repartitionByRange(by).withColumn("range", F.spark_partition_id()), "numbered")
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect()}
    offset, pairs = first - 1, []
    for part in sorted(sizes):
        pairs += [F.lit(part), F.lit(offset)]
        offset += sizes[part]
    start = F.create_map(*pairs)[F.col("range")] if pairs else F.lit(0)
    return ranged.withColumn(name, (F.row_number().over(Window.partitionBy("range").orderBy(by)) + start).cast("long")).drop("range")


def create(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(key, outcome) of inserting ``new`` keys: created, exists, or duplicate if the batch itself repeats one."""
    counted = new.groupBy("key").agg(F.count("*").alias("n")).join(stored.select("key").distinct().withColumn("there", F.lit(True)), "key", "left")
    return counted.select("key", F.when(F.col("there"), "exists").when(F.col("n") > 1, "duplicate").otherwise("created").alias("outcome"))


def merge(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """The table after versioned writes (key, version seen, value): the version must be the stored one, 0 for a new row."""
    w = writes.select("key", F.col("version").alias("seen"), F.col("value").alias("new"))
    both = stored.join(w, "key", "full")
    fits = F.coalesce("version", F.lit(0)) == F.col("seen")
    outcome = F.when(F.col("seen").isNull(), "kept").when(~fits, "conflict").when(F.col("version").isNull(), "created").otherwise("replaced")
    done = both.withColumn("outcome", outcome)
    takes = F.col("outcome").isin("created", "replaced")
    return done.select("key", F.when(takes, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"), F.when(takes, F.col("new")).otherwise(F.col("value")).alias("value"), "outcome").where("version is not null")


def holes(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows (key, claimed) held against owners (key, owner): ES_MISSING without one, AUTHORITY_MISMATCH for another, else ok."""
    return rows.join(owners, key, "left").withColumn("hole", F.when(F.col("owner").isNull(), "ES_MISSING").when(F.col("owner") != F.col("claimed"), "AUTHORITY_MISMATCH").otherwise("ok"))
