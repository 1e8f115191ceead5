"""A folder of dumps to artifacts, resumable, with a manifest."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimspark.operators import analytics, compress, joins
from palimspark.plans.stage import staged
from palimspark.sources import dumps, store


def finished(spark: SparkSession, out_dir: str) -> DataFrame:
    """page_id of the artifacts that are there."""
    if not os.path.isdir(out_dir) or not any(n.endswith(".comp.gz") for n in os.listdir(out_dir)):
        return spark.createDataFrame([], "page_id long")
    name = F.regexp_extract("path", r"page_([0-9]+)\.comp\.gz$", 1)
    return store.listing(spark, out_dir).select(name.try_cast("long").alias("page_id")).where("page_id is not null")


def save_pages(revisions: DataFrame, out_dir: str, titles: DataFrame | None = None, source: str = "", **solver) -> DataFrame:
    """Compresses and writes pages; their manifest rows, with error where a page couldn't be written."""
    began = time.time()
    # a dump is parsed once
    rows = compress.compress(staged(revisions.select("page_id", "idx", "revid", "ts", "text", "size"), "revisions"), **solver)
    told = {k: solver[k] for k in ("time_budget", "solver", "strategy") if k in solver}
    artifacts = compress.artifacts(rows, titles, **told)
    artifacts = staged(artifacts, "artifacts")
    # a row per page: its id, path and error
    done = staged(store.save(artifacts, out_dir), "written")
    report = analytics.manifest(analytics.summarize_artifacts(artifacts), source, time.time() - began)
    return report.drop("artifact").join(done, "page_id")


def sweep(
    spark: SparkSession, dump_dir: str, page_ids: list[int], out_dir: str, pattern: str = "*.bz2", index: DataFrame | None = None, resume: bool = True,
    force: bool = False, limit_per_page: int | None = None, max_pages: int | None = None, **solver,
) -> DataFrame:
    """Manifest of all wanted pages: written now, or skipped as finished before. Pages in no file are left out.

    Only files that cover a page still to do are read. A page in several of these
    comes from the one it is assigned to, if it is there, and counts once. The
    strategy is fptas unless told.
    """
    solver = {"strategy": "fptas"} | solver
    ids = spark.createDataFrame([(i,) for i in dict.fromkeys(page_ids)], "page_id long")
    found = joins.first_covering(ids, index if index is not None else dumps.index_dir(spark, dump_dir, pattern), ["path"]).select("page_id", "path")
    done = finished(spark, out_dir)
    todo = joins.left_to_do(found, done, force=force or not resume)
    files = [r.path for r in todo.select("path").distinct().orderBy("path").collect()]  # a dump's files: thousands at most
    skipped = joins.skipped(found, done) if resume and not force else found.where(F.lit(False)).withColumn("skipped", F.lit(True))
    out = skipped.select("page_id", F.col("path").alias("source_file"), "skipped")
    if files:
        pages = dumps.files_of(spark, dumps.xml_pages(spark, files), files)
        revisions = dumps.revisions(pages, todo, limit_per_page=limit_per_page, max_pages=max_pages)
        heads = staged(revisions.groupBy("page_id").agg(F.first("title").alias("title"), F.first("path").alias("source_file")), "heads")
        new = save_pages(revisions, out_dir, heads, **solver).drop("source_file").join(heads.select("page_id", "source_file"), "page_id")
        out = joins.append_rows(out, new)
    return out
