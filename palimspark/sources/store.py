"""Artifacts and manifests on disk."""

from __future__ import annotations

import csv
import gzip
import json
import os
import pathlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimspark.model import ARTIFACT, MANIFEST_LEAST


FILES = "*.comp.gz"
UTF8 = {"encoding": "utf-8"}


def file_name(page_id: int | None, title: str) -> str:
    """page_<id>.comp.gz, or the title without signs that a path can't have."""
    return f"page_{page_id}.comp.gz" if page_id is not None else "".join(c if c.isalnum() or c in " ._-" else "_" for c in title) + ".comp.gz"


def save(artifacts: DataFrame, folder: str) -> DataFrame:
    """One gzip JSON file per page, written where the rows are; page_id, artifact (path), error of each.

    folder is one that all executors share. A file is written beside its place
    and moved, so that a lost task leaves no half file, and a repeated one the same.
    """
    x = artifacts.select("page_id", "title", F.to_json(F.struct("title", "anchors", "patches", "meta", "base_texts")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths, errors = [], []
            for page, title, body in zip(*(b.column(i) for i in range(3))):
                path = os.path.join(folder, file_name(page.as_py(), title.as_py() or ""))
                try:
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "wb") as raw, gzip.GzipFile("", "wb", fileobj=raw, mtime=0) as out:
                        out.write(body.as_py().encode("utf-8"))
                    os.replace(part, path)
                    errors.append(None)
                except OSError as error:  # one page's failure is a row, not the job's end
                    errors.append(str(error))
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(errors, pa.string())], ["page_id", "artifact", "error"])

    return x.mapInArrow(run, "page_id long, artifact string, error string")


def load(spark: SparkSession, path: str, pattern: str = FILES) -> DataFrame:
    """Artifact rows, with their files' paths."""
    x = spark.read.schema(ARTIFACT).option("pathGlobFilter", pattern).json(path)
    return x.select("*", F.col("_metadata.file_path").alias("file"))


def listing(spark: SparkSession, folder: str, pattern: str = FILES) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").orderBy("path")


def write_manifest(rows: DataFrame, out: str, wrap: dict | None = None) -> None:
    """out.json and out.csv: sorted columns; a table without columns has those of MANIFEST_LEAST. wrap adds keys around the list.

    A manifest has one row per page of a run and goes through the driver row by row.
    """
    columns = sorted(rows.columns or MANIFEST_LEAST)
    told = lambda x: json.dumps(x, ensure_ascii=False, default=str)
    n = 0
    with pathlib.Path(f"{out}.csv").open(mode="w", newline="", **UTF8) as csv_file, pathlib.Path(f"{out}.json").open(mode="w", **UTF8) as json_file:
        writer = csv.DictWriter(csv_file, columns)
        writer.writeheader()
        json_file.write("[" if wrap is None else "{" + "".join(f"{told(k)}: {told(v)},\n" for k, v in wrap.items()) + '"items": [')
        for r in rows.toLocalIterator():
            writer.writerow(r.asDict())
            json_file.write(("," if n else "") + "\n" + told(r.asDict()))
            n += 1
        json_file.write("\n]" if wrap is None else f'\n], "count": {n}}}')


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV folder with a header, also when there are no rows."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
