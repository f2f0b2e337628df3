"""Job events as a stream: repeated deliveries dropped, counts kept, invalid payloads set apart."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "job_event_id bigint, job_id bigint, event_type string, payload string, created_at timestamp, ingested_at timestamp"
#: How far behind the newest event of the batches before an event may lie; the state of older ones is dropped, and so are they.
KEPT = "730 days"


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, from the session; a temporary one only on one machine and where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="millrace-stream-")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system is a folder."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(name).isDirectory()


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of the event table's files, one file or a folder of them."""
    path = f"{sf_dir}/job_events.parquet"
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 64)
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", "job_events.parquet").parquet(sf_dir)


def once(events: DataFrame) -> DataFrame:
    """Each event once, however often it was delivered; its state goes KEPT behind the newest event."""
    return events.where("created_at IS NOT NULL").withWatermark("created_at", KEPT).dropDuplicatesWithinWatermark(["job_event_id", "job_id", "event_type"])


def counts(events: DataFrame) -> DataFrame:
    """Events per job and type, each event counted once: repeated deliveries are dropped before, so a count is all the state."""
    different = events.dropDuplicates(["job_event_id", "job_id", "event_type"])
    return different.groupBy("job_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def routed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) events by their payload."""
    valid = F.try_parse_json("payload").isNotNull()
    return events.where(valid), events.where(~F.coalesce(valid, F.lit(False)))


def replay(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame], name: str, mode: str = "append") -> DataFrame:
    """Run a streaming transformation over all files now there, and read what it wrote.

    A batch overwrites its own folder, so one that is tried again is not written twice.
    """
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream = transform(read_events(spark, sf_dir))

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{base}/out/batch={number}" if mode == "append" else f"{base}/out/batch=0"
        batch.write.mode("overwrite").parquet(folder)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{base}/out").parquet(f"{base}/out").select(*stream.columns)
