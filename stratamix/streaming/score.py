"""Scoring of streams: the model's transformation is row-local, so it needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import MixtureModel


def score_folder(spark: SparkSession, model: MixtureModel, source: str, sink: str, checkpoint: str, schema) -> StreamingQuery:
    """Scores Parquet files as they arrive in ``source`` and appends them under ``sink``, each file once."""
    rows: DataFrame = spark.readStream.schema(schema).parquet(source)
    return model.transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
