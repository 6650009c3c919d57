"""An extension: the row-wise clean-up over a stream of transcripts. It keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def cleanup_stream(rows: DataFrame, column: str = "text") -> DataFrame:
    """Adds the cleaned text and the number of logged steps."""
    return rows.withColumn("clean", text.cleanup(F.col(column))).select(*rows.columns, "clean.cleaned", "clean.num_changes")
