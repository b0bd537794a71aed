"""The stateless metrics over a stream; an extension, since they are plain projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mcqlab.config import MetricConfig
from mcqlab.plans.evaluate import evaluate


def evaluated_stream(spark: SparkSession, source: str, schema, config: MetricConfig = MetricConfig()) -> DataFrame:
    """Metrics of MCQ rows as parquet files arrive in a folder."""
    return evaluate(spark.readStream.schema(schema).parquet(source), config)


def write_stream(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends to a parquet folder until the present input is used up."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
