"""Incremental indexing: documents that arrive as a stream are added to an index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import retrieval


def index_stream(docs: DataFrame, path: str, checkpoint: str, **build) -> StreamingQuery:
    """Writes each micro-batch's postings, sentences and documents below ``path``, under its batch id: a batch that runs again replaces its own files."""

    def add(batch: DataFrame, number: int) -> None:
        made = retrieval.build(batch, **build)
        for name in ("postings", "sentences", "documents"):
            getattr(made, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load(spark, path: str) -> retrieval.Index:
    return retrieval.Index(*(spark.read.parquet(f"{path}/{x}").drop("batch") for x in ("postings", "sentences", "documents")))
