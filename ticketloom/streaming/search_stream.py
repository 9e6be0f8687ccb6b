"""New records scored as they arrive: a stream of files searched against a built index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ticketloom.api import Engine
from ticketloom.sources.issues import SCHEMA


def read_records(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of flat JSON records (the source schema) with qid = issue_id; a bounded number of files per trigger."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(path)
    return stream.withColumn("qid", stream["issue_id"])


def search_stream(engine: Engine, records: DataFrame, output: str, checkpoint: str, model: str = "bm25", top_k: int = 10, **trigger) -> StreamingQuery:
    """Writes the matches of every micro-batch as Parquet; a batch that is run again replaces its own folder, so each counts once."""

    def match(batch: DataFrame, epoch: int) -> None:
        engine.search_new(batch.dropDuplicates(["qid"]), model, top_k).write.mode("overwrite").parquet(f"{output}/batch={epoch}")

    return records.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
