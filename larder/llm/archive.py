"""Files that tasks write themselves: temporary names, then a manifest, then final names.

A task writes each file under a name of its own attempt and returns a manifest
row. Spark commits the rows of one attempt of each task; the files they name
are then moved to their final names, and the manifest is written last. Readers
follow the manifest only, so files of lost or repeated attempts never count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import partitions


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a plain local path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


class TempFile:
    """A file under a name that no other attempt uses."""

    def __init__(self, root: str):
        self.name = f"_temporary/{uuid.uuid4().hex}"
        store, path = filesystem(root)
        store.create_dir(f"{path}/_temporary", recursive=True)
        self._out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.bytes = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        self._out.close()


def open_file(root: str, name: str) -> pa.NativeFile:
    store, path = filesystem(root)
    return store.open_input_file(f"{path}/{name}")


def publish(rows: DataFrame, root: str) -> DataFrame:
    """Write the files that computing ``rows(temp, file, ...)`` makes, give them their final names, return the manifest."""
    spark: SparkSession = rows.sparkSession
    rows.write.parquet(f"{root}/_written")
    written = spark.read.parquet(f"{root}/_written")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(root)
        for batch in batches:
            for temp, file in zip(batch.column("temp").to_pylist(), batch.column("file").to_pylist(), strict=True):
                source, target = f"{path}/{temp}", f"{path}/{file}"
                # a repeated attempt finds the file moved
                if store.get_file_info(source).type != pafs.FileType.NotFound:
                    store.move(source, target)
                elif store.get_file_info(target).type == pafs.FileType.NotFound:
                    raise FileNotFoundError(source)
            yield batch.select(["file"])

    written.select("temp", "file").distinct().repartition(partitions(spark)).mapInArrow(move, "file string").agg(F.count("file")).collect()
    written.drop("temp").write.parquet(f"{root}/manifest")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/manifest")
