"""Writers: edge lists, flattened exports, results, manifests with checksums and a static report."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_edges(edges: DataFrame, path: str) -> None:
    edges.select("source", "target").write.option("header", True).csv(path)


def binary_content(edges: DataFrame) -> DataFrame:
    """``part, content``: little-endian pairs of each partition, in row order."""

    def run(some: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, rows in enumerate(some):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() * 1_000_000 + k], "content": [rows[["source", "target"]].to_numpy(np.int64).astype("<u8").tobytes()]})

    return edges.select("source", "target").mapInPandas(run, "part bigint, content binary")


def binary_edge_files(edges: DataFrame, path: str) -> None:
    """A folder of binary files of little-endian pairs, one a task, in the store that the path names."""
    from tessera.sources.readers import fs_of

    store, root = fs_of(path)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = fs_of(path)
        context = TaskContext.get()
        # an attempt writes its own file; a renamed one is whole, and a later attempt replaces it
        aside, name = f"{base}/.{context.partitionId()}-{context.taskAttemptId()}", f"{base}/part-{context.partitionId():05d}.bin"
        rows = 0
        with own.open_output_stream(aside) as out:
            for b in batches:
                pairs = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1).astype("<u8")
                out.write(pairs.tobytes())
                rows += len(pairs)
        own.move(aside, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], ["file", "rows"])

    pairs = edges.select(F.col("source").cast("bigint"), F.col("target").cast("bigint"))
    pairs.mapInArrow(run, "file string, rows bigint").write.format("noop").mode("overwrite").save()


def binary_edges(edges: DataFrame, path: str) -> int:
    """One binary file of all pairs, streamed part by part through the driver; returns its bytes."""
    total = 0
    with open(path, "wb") as f:
        for row in binary_content(edges).orderBy("part").toLocalIterator():
            total += f.write(row["content"])
    return total


def flattened(df: DataFrame) -> DataFrame:
    """Nested records as dotted columns; lists, maps and deeper levels as JSON text."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType:
                inner = F.col(f"`{f.name}`.`{g.name}`")
                out.append((F.to_json(inner) if isinstance(g.dataType, (T.StructType, T.ArrayType, T.MapType)) else inner).alias(f"{f.name}.{g.name}"))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    flat = flattened(df)
    if kind == "csv":
        flat.write.option("header", True).csv(path)
    elif kind == "parquet":
        flat.write.parquet(path)
    elif kind == "json":
        df.write.json(path)
    else:
        raise ValueError(kind)


def batched(df: DataFrame, path: str, rows: int) -> None:
    """Appends files of at most so many rows."""
    df.write.option("maxRecordsPerFile", rows).mode("append").parquet(path)


def file_hashes(spark: SparkSession, directory: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, directory: str, name: str) -> dict:
    """Name and every file's size and SHA-256."""
    rows = file_hashes(spark, directory).where("name <> 'manifest.json'").orderBy("name").collect()
    return {"name": name, "files": [r.asDict() for r in rows]}


def verify(spark: SparkSession, directory: str, expected: dict) -> list[str]:
    """Faults of a folder against its manifest: missing or differing files."""
    want = spark.createDataFrame([(f["name"], f["bytes"], f["sha256"]) for f in expected["files"]], "name string, bytes bigint, sha256 string")
    have = file_hashes(spark, directory)
    bad = want.alias("w").join(have.alias("h"), "name", "left").where("h.sha256 is null or h.sha256 <> w.sha256 or h.bytes <> w.bytes")
    rows = bad.select("name", F.when(F.col("h.sha256").isNull(), "missing").otherwise("differs").alias("fault")).orderBy("name").collect()
    return [f"{r['name']}: {r['fault']}" for r in rows]


def report(results: DataFrame) -> str:
    """A static page of mean warm times by benchmark and engine."""
    rows = results.groupBy("benchmark", "engine").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("warm_ms"), 3).alias("warm_ms")).orderBy("benchmark", "engine").collect()
    engines = len({r["engine"] for r in rows})
    top = max((r["warm_ms"] or 0 for r in rows), default=0) or 1
    body = "".join(f"<tr><td>{html.escape(str(r['benchmark']))}</td><td>{html.escape(str(r['engine']))}</td><td>{r['runs']}</td><td>{r['warm_ms']}</td><td><div style='width:{200 * (r['warm_ms'] or 0) / top:.0f}px;height:8px;background:#456'></div></td></tr>" for r in rows)
    data = html.escape(json.dumps([r.asDict() for r in rows]))
    return f"<!doctype html><title>Results</title><p>{len(rows)} rows, {engines} engines</p><table data-rows='{data}'><tr><th>benchmark<th>engine<th>runs<th>warm ms<th></tr>{body}</table>"
