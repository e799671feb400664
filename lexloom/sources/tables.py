"""Binary index files as DataFrames, through Spark's Python data source API.

``spark.read.format("lexloom").option("kind", k).load(path)`` for k = btree, keyfile or
bulk_tree has rows (key, value); postings, lengths, names and corpus decode the values of B-trees; collection
decodes a compressed collection.  B-trees are split by runs of blocks, so that tasks read them in
parallel; ``path`` has to be on a file system that all executors see.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import LexloomError
from . import btree, bulk_tree, keyfile
from .streams import text

SCHEMAS = {
    "btree": "key binary, value binary",
    "keyfile": "key binary, value binary",
    "bulk_tree": "key binary, value binary",
    "postings": "term string, df long, cf long, doc_id long, tf int, positions array<int>",
    "lengths": "field string, doc_id long, length int",
    "names": "doc_id long, name string",
    "corpus": "doc_id long, metadata array<struct<key: string, value: string>>, text string",
    "collection": "doc_id long, text string, content string",
}


class Run(InputPartition):
    """Blocks ``begin`` to ``end`` of a B-tree; other files are one partition."""

    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.path = options.get("kind", "btree"), options.get("path")
        self.blocks = int(options.get("blocksPerPartition", "64"))
        if not self.path:
            raise LexloomError("a path is needed")

    def partitions(self) -> list[InputPartition]:
        if self.kind in ("keyfile", "bulk_tree", "collection"):
            return [Run(0, 0)]
        n = len(btree.BTree(self.path).blocks)
        return [Run(k, min(n, k + self.blocks)) for k in range(0, n, self.blocks)]

    def read(self, partition: Run) -> Iterator[tuple]:
        if self.kind == "keyfile":
            yield from keyfile.Keyfile(self.path).items()
        elif self.kind == "bulk_tree":
            yield from bulk_tree.BulkTree(self.path).items()
        elif self.kind == "collection":
            for doc_id, d in keyfile.CompressedCollection(self.path).items():
                yield doc_id, d.text, d.content
        else:
            tree = btree.BTree(self.path)
            for block in tree.blocks[partition.begin : partition.end]:
                for key, value in tree.block_items(block):
                    yield from self._rows(key, value)

    def _rows(self, key: bytes, value: bytes) -> Iterator[tuple]:
        if self.kind == "btree":
            yield key, value
        elif self.kind == "postings":
            df, cf, found = btree.read_postings(value)
            for p in found:
                yield text(key), df, cf, p.doc_id, p.tf, list(p.positions)
        elif self.kind == "lengths":
            table = btree.read_lengths(value)
            for k, n in enumerate(table.values):
                yield text(key), table.first + k, n
        elif self.kind == "names":
            yield int.from_bytes(key, "big"), text(value)
        else:
            d = btree.read_document(value)
            yield int.from_bytes(key, "big"), [{"key": k, "value": v} for k, v in d.metadata], d.text


class IndexSource(DataSource):
    """The data source ``lexloom``."""

    @classmethod
    def name(cls) -> str:
        return "lexloom"

    def schema(self) -> str:
        kind = self.options.get("kind", "btree")
        if kind not in SCHEMAS:
            raise LexloomError(f"unknown kind of file: {kind}")
        return SCHEMAS[kind]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexSource)
