"""Lines from any table of texts, and from files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import text_of

BINARY_PROBE = 8192
#: Bytes of files that a worker hands on together, about.
BATCH = 32 << 20


def lines_from_text(df: DataFrame, path: Column, text: Column, *keep: str) -> DataFrame:
    """(path, line_no, line, *keep): numbered from 1; raw-empty lines count but are dropped; one trailing CR goes."""
    rows = df.select(path.alias("path"), *keep, F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    return rows.where("raw <> ''").select("path", (F.col("at") + 1).alias("line_no"), F.regexp_replace("raw", r"\r\z", "").alias("line"), *keep)


def _read_local(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """(path, status, content): workers open the files themselves, whatever their names; one that can't be read is an error."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            held, size = [], 0
            for x in p["path"]:
                try:
                    held.append((x, "ok", Path(root, x).read_bytes()))
                except OSError:
                    held.append((x, "error", None))
                size += len(held[-1][2] or b"")
                if size >= BATCH:
                    yield pd.DataFrame(held, columns=["path", "status", "content"])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["path", "status", "content"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(min(max(len(paths) // 64, 1), spark.sparkContext.defaultParallelism * 4)).mapInPandas(read, "path string, status string, content binary")


def escaped(path: str) -> str:
    """A path that names itself where patterns are expected."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_files(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """(path, status, content): status is ok, binary (a NUL in the first bytes) or error (can't be read; without content).

    Files of a local root are opened by the workers. Of other stores Spark's reader takes them, which leaves out names
    that start with a dot or an underscore."""
    root = root.rstrip("/")
    if not paths:
        return spark.createDataFrame([], "path string, status string, content binary")
    if "://" not in root or root.startswith("file:"):
        found = _read_local(spark, paths, re.sub("^file:/+", "/", root))
    else:
        got = spark.read.format("binaryFile").load([escaped(f"{root}/{p}") for p in paths])
        found = got.select(F.substring_index("path", root + "/", -1).alias("path"), F.lit("ok").alias("status"), "content")
    binary = F.position(F.lit(b"\0"), F.substring("content", 1, BINARY_PROBE)) > 0
    return found.select("path", F.when(binary, "binary").otherwise(F.col("status")).alias("status"), "content")


def lines_of(files: DataFrame) -> DataFrame:
    """The lines of what ``read_files`` has read."""
    return lines_from_text(files.where("status = 'ok'"), F.col("path"), text_of(F.col("content")))


def lines_from_files(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    return lines_of(read_files(spark, paths, root))
