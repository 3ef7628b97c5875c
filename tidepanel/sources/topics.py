"""A log of topics in files, as a streaming source with an offset for each partition of each topic.

Layout: <path>/<topic>/<partition>/<first>-<last>.json, lines of {"key", "value"}; a segment never changes once it is there. Paths are any
that Arrow's file systems know (a shared folder, HDFS, S3). Rows are topic, partition, offset, key, value, as a message broker's
connector gives them, so `streaming.drain.log_topics` takes either by its format's name."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "topic_files"
SCHEMA = "topic string, partition int, offset long, key string, value string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def segments(path: str, topics: list[str] | None = None) -> dict[str, list[tuple[int, int, str]]]:
    """Of each "topic/partition" its segments (first and last offset, name) in order."""
    system, root = _open(path)
    found: dict[str, list[tuple[int, int, str]]] = {}
    for f in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = f.path.removeprefix(root).strip("/").split("/")
        if f.type == pafs.FileType.File and len(parts) == 3 and parts[2].endswith(".json") and parts[2][0] not in "._" and (topics is None or parts[0] in topics):
            first, last = map(int, parts[2].removesuffix(".json").split("-"))
            found.setdefault(f"{parts[0]}/{parts[1]}", []).append((first, last, f.path))
    return {k: sorted(v) for k, v in found.items()}


@dataclass
class Range(InputPartition):
    """Offsets [start, end) of one partition of a topic."""

    name: str
    start: int
    end: int


class TopicReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.topics = options["subscribe"].split(",") if options.get("subscribe") else None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {k: v[-1][1] + 1 for k, v in sorted(segments(self.path, self.topics).items())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(k, start.get(k, 0), end[k]) for k in end if start.get(k, 0) < end[k]]

    def read(self, partition: Range):
        system, _ = _open(self.path)
        topic, number = partition.name.split("/")
        for first, last, at in segments(self.path, [topic]).get(partition.name, []):
            if last < partition.start or first >= partition.end:
                continue
            with system.open_input_stream(at) as f:
                for k, line in enumerate(f.read().decode().splitlines()):
                    if partition.start <= first + k < partition.end:
                        x = json.loads(line)
                        yield topic, int(number), first + k, x["key"], x["value"]

    def commit(self, end: dict) -> None:
        """Nothing to release: the checkpoint holds the offsets."""


class TopicFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TopicReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicFiles)


def append(rows: DataFrame, path: str, topic: str, key: str, partitions: int = 4, segment: int = 10_000) -> int:
    """Append rows as JSON values, dealt to the topic's partitions by a hash of their key; returns how many. Offsets go on where each partition ends; a segment's
    rows are one task's group of at most `segment` rows, and a segment appears whole."""
    ends = {k: v[-1][1] + 1 for k, v in segments(path, [topic]).items()}
    start = F.element_at(F.create_map(*[x for p in range(partitions) for x in (F.lit(p), F.lit(ends.get(f"{topic}/{p}", 0)).cast("long"))]), F.col("partition"))
    out = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")).withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("partition").orderBy("key", "value")) - 1).withColumn("offset", start + F.col("n")).withColumn("part", F.expr(f"n div {segment}"))

    def write(pdf):
        import pandas as pd

        pdf = pdf.sort_values("offset")
        system, root = _open(path)
        folder = f"{root}/{topic}/{pdf['partition'].iloc[0]}"
        name = f"{pdf['offset'].iloc[0]:020d}-{pdf['offset'].iloc[-1]:020d}.json"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/.{name}") as f:
            f.write("\n".join(json.dumps({"key": k, "value": v}) for k, v in zip(pdf["key"], pdf["value"], strict=True)).encode())
        system.move(f"{folder}/.{name}", f"{folder}/{name}")
        return pd.DataFrame({"n": [len(pdf)]})

    return out.groupBy("partition", "part").applyInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
