"""Validation of streams: documents are validated where they arrive, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treegrammar.operators.validate import validate
from treegrammar.plans.model import CompiledSchema


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(doc_id, xml) of XML files that arrive in a folder; doc_id is the file's path."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    return stream.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xml"))


def validate_stream(docs: DataFrame, schema: CompiledSchema, out: str, checkpoint: str, id_col: str = "doc_id", xml_col: str = "xml", trigger: dict | None = None) -> StreamingQuery:
    """Writes result rows as Parquet files, exactly once."""
    return validate(docs, schema, id_col, xml_col).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
