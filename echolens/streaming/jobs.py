"""Structured Streaming around the state queries: files in, admitted items and decisions out, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import numbered
from . import state

REQUEST = "ord long, scope_id string, request_id string, item_id string, text string"


def read_requests(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files).parquet(path)


def run_admission(requests: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Admits each micro-batch against all that was admitted before and appends receipts under ``out``.

    A batch is written to a folder named by its number, so a batch that is run again replaces what it wrote: with the
    checkpoint's offsets this makes receipts exactly-once. One query owns the folder; numbers follow those already given.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{out}/batch={number:010d}"
        try:
            before = spark.read.parquet(out).where(F.col("batch") < number)
        except Exception as e:  # the first batch: nothing is there to read
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            before = None
        history = batch.limit(0) if before is None else before.where("status = 'accepted'").select(*batch.columns)
        top = 0 if before is None else (before.agg(F.max("arrival_seq").alias("m")).first()["m"] or 0)
        keys = batch.select("scope_id", "request_id", "item_id").distinct()
        old = history.join(keys.select("scope_id", "request_id").distinct(), ["scope_id", "request_id"], "left_semi").unionByName(history.join(keys.select("scope_id", "item_id").distinct(), ["scope_id", "item_id"], "left_semi").select(*history.columns)).select(*batch.columns).distinct()
        marked = old.withColumn("ord", F.col("ord") - (1 << 40)).unionByName(batch)
        admitted = state.admit(marked, 1).where("ord > -1000000000").drop("arrival_seq")
        numbers = numbered(admitted.where("status = 'accepted'").select("ord"), "ord", "arrival_seq", top + 1)
        receipts = admitted.join(numbers, "ord", "left").join(batch.select("ord", "text"), "ord")
        receipts.write.mode("overwrite").parquet(target)

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
