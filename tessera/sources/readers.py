"""Readers of graph files: CSV, binary and text edge lists, pipe-delimited tables, results and manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def csv_edges(spark: SparkSession, path: str) -> DataFrame:
    """``source, target``; a first line that starts with ``source`` is a header, fields are trimmed."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, 'source')")
    parts = F.split("value", ",")
    return rows.select(F.trim(F.get(parts, F.lit(0))).cast("bigint").alias("source"), F.trim(F.get(parts, F.lit(1))).cast("bigint").alias("target"))


class BinaryPairs(DataSource):
    """Little-endian pairs of 64-bit ids as a data source; a file is read in byte ranges of ``rangeBytes``, each a task."""

    @classmethod
    def name(cls) -> str:
        return "binary_pairs"

    def schema(self) -> str:
        return "source bigint, target bigint"

    def reader(self, schema):
        return PairReader(json.loads(self.options["files"]), int(self.options.get("rangeBytes", RANGE_BYTES)))


#: Bytes of a binary file that one task reads, whole pairs; tasks from which on smaller ranges are joined, up to that size.
RANGE_BYTES, TASKS = 64 << 20, 200


class PairReader(DataSourceReader):
    def __init__(self, files: list, range_bytes: int):
        self.files, self.step = files, max(16, range_bytes // 16 * 16)

    def partitions(self):
        # neighbouring ranges of a file go to one task where there are many: a task for each tiny one costs more than to read it
        ranges = sum(-(-size // self.step) for _, size in self.files)
        step = self.step * max(min(-(-ranges // TASKS), RANGE_BYTES // self.step), 1)
        return [InputPartition((path, a, min(step, size - a))) for path, size in self.files for a in range(0, size, step)] or [InputPartition(("", 0, 0))]

    def read(self, partition):
        path, start, size = partition.value
        if not size:
            return
        with open_input(path) as f:
            f.seek(start)
            while size > 0:
                some = f.read(min(size, 16 << 20))
                if len(some) < min(size, 16 << 20):
                    raise ValueError(f"{path} has become shorter")
                size -= len(some)
                pairs = np.frombuffer(some, "<u8").reshape(-1, 2)
                if pairs.max() > np.iinfo(np.int64).max:
                    raise ValueError(f"{path}: an id is beyond 2^63 - 1")
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].astype(np.int64)) for k in (0, 1)], ["source", "target"])


def fs_of(path: str) -> tuple[fs.FileSystem, str]:
    """(store, path in it) of a path whose scheme pyarrow knows."""
    return fs.FileSystem.from_uri(path)


def open_input(path: str):
    """A file that tasks can seek in."""
    store, name = fs_of(path)
    return store.open_input_file(name)


def binary_edges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``source, target`` of little-endian 64-bit pairs; a file whose size is no multiple of 16 is an error.

    Files are listed by the cluster's own file system and read in byte ranges,
    so a file of any size is read by many tasks.  Where the store has a scheme
    that pyarrow cannot open, Spark reads each file whole (2 GB at most).
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # names and sizes, no contents
    for r in listed:
        if r["length"] % 16:
            raise ValueError(f"{r['path']}: {r['length']} bytes are no whole pairs")
    uris = [(r["path"].replace("file:/", "file:///", 1) if r["path"].startswith("file:/") and not r["path"].startswith("file://") else r["path"], r["length"]) for r in listed]
    if all(u.split(":", 1)[0] in ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss") for u, _ in uris):
        spark.dataSource.register(BinaryPairs)
        return spark.read.format("binary_pairs").option("files", json.dumps(uris)).option("rangeBytes", range_bytes).load()

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in files:
            for content in some["content"]:
                pairs = np.frombuffer(content, "<u8").reshape(-1, 2)
                if len(pairs) and pairs.max() > np.iinfo(np.int64).max:
                    raise ValueError("an id is beyond 2^63 - 1")
                yield pd.DataFrame(pairs.astype(np.int64), columns=["source", "target"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "source bigint, target bigint")


def text_edges(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``source, target`` of white-space separated lines (gzip too); blank and ``#`` lines are skipped, bad numbers too unless ``strict``."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    a, b = (F.get(F.split("line", r"\s+"), F.lit(k)) for k in (0, 1))
    if strict:
        return rows.select(a.cast("bigint").alias("source"), b.cast("bigint").alias("target"))
    return rows.select(a.try_cast("bigint").alias("source"), b.try_cast("bigint").alias("target")).where("source is not null and target is not null")


def endpoint_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()


def piped(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Pipe-delimited table by its header, or by position where a schema is given (header names may repeat)."""
    reader = spark.read.option("sep", "|").option("header", True)
    return reader.schema(schema).option("enforceSchema", True).csv(path) if schema else reader.csv(path)


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def arrays_graph(spark: SparkSession, edge_index: np.ndarray, features: np.ndarray | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Edge and node tables of a 2 x m index array and an n x d feature array."""
    edges = spark.createDataFrame(pd.DataFrame({"source": edge_index[0].astype(np.int64), "target": edge_index[1].astype(np.int64)}))
    if features is None:
        return edges, None
    return edges, spark.createDataFrame(pd.DataFrame({"id": np.arange(len(features)), "feature": [f.astype(float).tolist() for f in features]}), "id bigint, feature array<double>")


def batch(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows of a parameter list."""
    return spark.createDataFrame(rows, schema)


def unwind(df: DataFrame, xs: str, name: str) -> DataFrame:
    """One row per element; null and empty lists give none."""
    return df.withColumn(name, F.explode(xs))


RESULT_SCHEMA = "benchmark string, engine string, timestamp string, cold_ms double, warm_ms double, samples array<double>, rows bigint, correctness struct<passed:boolean,message:string>, host struct<cpu:string,memory_gb:double>, outcome string"


def results(spark: SparkSession, directory: str, engine: str | None = None, benchmark: str | None = None) -> DataFrame:
    """Result records of all ``*.json`` files, of one engine or benchmark where named, with their file, in name order."""
    rows = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(f"{directory}/*.json")
    for name, value in (("engine", engine), ("benchmark", benchmark)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.select("*", F.col("_metadata.file_name").alias("file")).orderBy("file")


def manifests(spark: SparkSession, directory: str) -> DataFrame:
    """``path, content`` of every ``manifest.json`` below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").load(directory).select("path", F.decode("content", F.lit("utf-8")).alias("content"))
