"""Appending to a written index from a stream: every micro-batch is a segment of its own.

Statistics are aggregations over segments, so nothing is merged; a batch that is delivered again
(after a failure) replaces its segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import IndexSchema, build_index, write_index


def _has_segment(spark, path: str, segment: int) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/documents/segment={segment}")
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def _drop_segment(spark, path: str, segment: int) -> None:
    for table in ("postings", "vocabulary", "lengths", "statistics", "documents"):
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/segment={segment}")
        root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def append_segment(batch: DataFrame, schema: IndexSchema, path: str, segment: int) -> None:
    """Write one segment; what an earlier attempt left of it is dropped first."""
    spark = batch.sparkSession
    if _has_segment(spark, path, segment):
        _drop_segment(spark, path, segment)
    if not batch.isEmpty():
        write_index(build_index(batch, schema), path, segment)


def stream_into_index(documents: DataFrame, schema: IndexSchema, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Index a stream of documents; starts the query."""
    writer = documents.writeStream.foreachBatch(lambda batch, number: append_segment(batch, schema, path, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
