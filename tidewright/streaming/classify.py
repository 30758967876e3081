"""Classification of a stream of requests: the batch plan on each micro-batch, without streaming state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dimensions import Model
from ..operators.pipeline import persist, valid
from ..operators.scoring import banded, scored
from ..sources.sinks import swap

#: Bytes of request files that a micro-batch takes.
MOST_BYTES = 512 << 20


def classify_stream(requests: DataFrame, vectors: DataFrame, model: Model) -> DataFrame:
    """Streaming requests joined to a static table of vectors (shipment_id, embedding), scored and banded."""
    rows = valid(requests).join(vectors.select("shipment_id", "embedding"), "shipment_id", "left")
    return banded(scored(rows, model), model, F.col("threshold")).select("shipment_id", "requested_at", "confidence_state", F.array_join("categories", ",").alias("categories"), "max_score")


def persist_stream(requests: DataFrame, existing: str, model: Model, version: str, clock: Column, checkpoint: str) -> None:
    """Predicts every micro-batch and upserts its results into the table at `existing`; a batch that runs again changes nothing."""
    spark = requests.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        swap(persist(spark.read.parquet(existing), batch, model, version, clock), existing)

    requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(out: DataFrame, checkpoint: str, path: str) -> None:
    """Writes what has arrived to Parquet, exactly once, and stops."""
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_requests(spark: SparkSession, path: str, only: str = "*") -> DataFrame:
    """The stream of a folder's request files that have a name like `only`, or of the one file at `path`, with the schema of what is there.

    A table may be either. A micro-batch is bounded by bytes, since each reads the static vectors again.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path, only = at.getParent().toString(), at.getName()
    schema = spark.read.option("pathGlobFilter", only).parquet(path).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", MOST_BYTES).option("pathGlobFilter", only).parquet(path)
