"""Sinks: JSON lines of records, dataset, statistics, registry and state. Runs overwrite the partitions
they write (by doc_id), so a run that is repeated leaves no copies."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_dataset(items: DataFrame, path: str) -> None:
    """The four fields, in the dataset's shuffled order."""
    items.sort("position").select("text", "latex", "source", "class").write.mode("overwrite").json(path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """The raw candidates, before they are classified."""
    candidates.write.mode("overwrite").json(path)


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """PNG files of ``images`` (name, image) in a folder that all executors share, by paths that their names
    give, so a run that is repeated overwrites its own; gives name and path. Null images go."""

    def put(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            paths = [os.path.join(folder, re.sub(r"[^A-Za-z0-9\-_.]", "_", n) + ".png") for n in df["name"]]
            os.makedirs(folder, exist_ok=True)
            for path, image in zip(paths, df["image"], strict=True):
                part = f"{path}.{uuid.uuid4().hex}"  # moved into place whole, whichever attempt of a task is last
                with open(part, "wb") as f:
                    f.write(bytes(image))
                os.replace(part, path)
            yield pd.DataFrame({"name": df["name"], "path": paths})

    return images.where("image is not null and name is not null").select("name", "image").mapInPandas(put, "name string, path string")


REGISTRY = "name string, hash string, added_at string, size_mb double, url string"


def append_registry(accepted: DataFrame, path: str) -> None:
    """Adds the rows whose name and hash aren't there yet, so a run that is repeated leaves no copies."""
    known = read_json(accepted.sparkSession, path, REGISTRY).select("name", "hash")
    accepted.join(known, ["name", "hash"], "left_anti").write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON under a schema; a path that isn't there reads as an empty table."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
