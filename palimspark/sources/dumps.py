"""Export dumps: XML pages, page index, KnolML, listings and range files."""

from __future__ import annotations

import os
import shutil
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimspark.functions.times import iso_to_ts
from palimspark.operators.joins import page_filter

PAGE = (
    "id long, ns int, title string, revision array<struct<id:string,timestamp:string,contributor:struct<username:string,id:long,ip:string>,"
    "comment:string,sha1:string,text:struct<_VALUE:string,_bytes:long>>>"
)
RANGE_NAME = r"p([0-9]+)p([0-9]+)"
PART_NAME = r"pages-meta-history([0-9]*)\.xml-p([0-9]+)p([0-9]+)\.(bz2|7z|gz)"


def xml_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per page of plain, bz2 or gz export files; a file is one task, so spread the rows before heavy work."""
    paths = [path] if isinstance(path, str) else path
    if any(p.endswith(".7z") for p in paths):
        raise ValueError("7z isn't a codec that Spark reads; unpack the file or take its bz2 twin")
    reader = spark.read.format("xml").schema(PAGE).option("rowTag", "page").option("ignoreSurroundingSpaces", "false").option("attributePrefix", "_")
    return reader.load(paths)


def once(pages: DataFrame, *first: Column) -> DataFrame:
    """One row of each page id: first by the given order, then with the most revisions, then by a hash of the row. Rows without an id stay."""
    x = pages.withColumn("_own", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    best = W.partitionBy("id", "_own").orderBy(*first, F.size("revision").desc(), F.xxhash64("ns", "title", "revision"))
    return x.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_own", "_n")


def files_of(spark: SparkSession, pages: DataFrame, paths: list[str]) -> DataFrame:
    """Adds path: the one of paths that a page was read from, as it is written there."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    known = []
    for name in paths:
        at = path(name)
        known.append((at.getFileSystem(conf).makeQualified(at).toUri().toString(), name))
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    names = spark.createDataFrame(known, "_file string, path string").withColumn("_file", same(F.col("_file")))
    return pages.withColumn("_file", same(F.col("_metadata.file_path"))).join(F.broadcast(names), "_file", "left").drop("_file")


def revisions(
    pages: DataFrame, page_ids: list[int] | DataFrame | None = None, titles: list[str] | None = None, limit_per_page: int | None = None,
    limit: int | None = None, max_pages: int | None = None,
) -> DataFrame:
    """Revision rows of the wanted pages (every page where neither ids nor titles are given).

    A missing id is -1, a missing time stamp or text is empty. A page that a dump
    holds twice counts once: the row with the most revisions. Where pages and the
    table of ids both have a path, a row from that path goes before the others, and
    path is kept.
    """
    first, own = [], [c for c in ("path",) if c in pages.columns]
    x = pages.limit(max_pages) if max_pages is not None else pages
    if isinstance(page_ids, DataFrame):
        wanted = page_ids.select(F.col("page_id").alias("id"), *[F.col(c).alias("_" + c) for c in own if c in page_ids.columns]).dropDuplicates(["id"])
        first = [F.coalesce(F.col("path") == F.col("_path"), F.lit(False)).desc()] if "_path" in wanted.columns else []
        x = x.join(wanted, "id")
    elif page_ids is not None:
        x = x.where(F.col("id").isin(page_ids) | (F.col("id").isNull() & F.col("title").isin(titles or [])))
    elif titles is not None:
        x = x.where(F.col("title").isin(titles))
    x = once(x, *first).select(F.col("id").alias("page_id"), "title", *own, F.posexplode_outer("revision").alias("idx", "r")).where("r is not null")
    if limit_per_page:
        x = x.where(F.col("idx") < limit_per_page)
    stamp = F.coalesce(F.trim("r.timestamp"), F.lit(""))
    text = F.coalesce("r.text._VALUE", F.lit(""))
    x = x.select(
        "page_id", "title", "idx", F.coalesce(F.trim("r.id").try_cast("long"), F.lit(-1)).alias("revid"), stamp.alias("timestamp"), iso_to_ts(stamp).alias("ts"),
        text.alias("text"), F.length(text).cast("long").alias("size"), F.col("r.text._bytes").alias("bytes"), F.col("r.sha1").alias("sha1"),
        F.coalesce("r.contributor.username", "r.contributor.ip").alias("contributor"), F.col("r.comment").alias("comment"), *own,
    )
    return x.orderBy("page_id", "idx").limit(limit) if limit is not None else x


def history(spark: SparkSession, path: str, title: str | None = None, page_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Revisions by title and/or page id; limit is over all matching pages."""
    pages = xml_pages(spark, path).withColumn("page_id", F.col("id")).where(page_filter(title, page_id)).drop("page_id")
    return revisions(pages, limit=limit)


def legacy_sizes(pages: DataFrame) -> DataFrame:
    """page_id, idx, size: the bytes attribute, or the length of the text, or 0."""
    x = pages.select(F.col("id").alias("page_id"), F.posexplode("revision").alias("idx", "r"))
    return x.select("page_id", "idx", F.coalesce("r.text._bytes", F.length("r.text._VALUE").cast("long"), F.lit(0)).alias("size"))


def page_index(spark: SparkSession, path: str, namespaces: list[int] | None = None) -> DataFrame:
    """page_id, title, file of each page: where a page is, in place of byte offsets."""
    x = xml_pages(spark, path)
    if namespaces is not None:
        x = x.where(F.col("ns").isin(namespaces))
    return x.select(F.col("id").alias("page_id"), "title", F.col("_metadata.file_path").alias("file"))


def to_parquet(spark: SparkSession, path: str, out: str) -> int:
    """A dump as Parquet sorted by page_id, so that a page is found by file and row-group statistics; the number of pages."""
    x = xml_pages(spark, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x.repartitionByRange(parts, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()


def read_page(spark: SparkSession, parquet: str, page_id: int) -> DataFrame:
    return revisions(spark.read.parquet(parquet).where(F.col("id") == page_id))


def range_index(names: DataFrame, name: str = "path") -> DataFrame:
    """path, lo, hi of names that carry a range of page ids; the others are left out."""
    base = F.element_at(F.split(F.col(name), "/"), -1)
    x = names.select(F.col(name).alias("path"), F.regexp_extract(base, RANGE_NAME, 1).alias("a"), F.regexp_extract(base, RANGE_NAME, 2).alias("b"))
    return x.where("a != ''").select("path", F.col("a").cast("long").alias("lo"), F.col("b").cast("long").alias("hi"))


def index_dir(spark: SparkSession, folder: str, pattern: str = "*.bz2") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return range_index(files).orderBy("path")


def save_index(index: DataFrame, path: str) -> None:
    index.coalesce(1).write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, lo long, hi long").json(path)


def parts_from_names(names: DataFrame, url: str, name: str = "name") -> DataFrame:
    """url, start, end, part, fname, ext of dump files, by part and start; other names are left out."""
    got = lambda i: F.regexp_extract(F.col(name), PART_NAME, i)
    x = names.where(F.col(name).rlike(PART_NAME)).select(
        F.concat(F.lit(url.rstrip("/") + "/"), F.col(name)).alias("url"), got(2).cast("long").alias("start"), got(3).cast("long").alias("end"),
        F.when(got(1) != "", got(1).cast("int")).otherwise(F.lit(0)).alias("part"), F.col(name).alias("fname"), got(4).alias("ext"),
    )
    return x.distinct().orderBy("part", "start")


def parts_from_status(spark: SparkSession, status_json: str, url: str) -> DataFrame:
    """From the text of a status file: the files of the full-history jobs."""
    jobs = spark.createDataFrame([(status_json,)], "j string").select(F.from_json("j", "jobs map<string, struct<files: map<string, struct<url: string>>>>").alias("s"))
    files = jobs.select(F.explode("s.jobs").alias("job", "v")).where("job like 'metahistory%'").select(F.explode(F.map_keys("v.files")).alias("name"))
    return parts_from_names(files, url)


def parts_from_html(spark: SparkSession, html: str, url: str) -> DataFrame:
    names = spark.createDataFrame([(html,)], "h string").select(F.explode(F.regexp_extract_all("h", F.lit(r'[^"/<> ]*' + PART_NAME), F.lit(0))).alias("name"))
    return parts_from_names(names, url)


def list_parts(spark: SparkSession, url: str, fetch: Callable[[str], str | None]) -> DataFrame:
    """Status file, else the HTML listing, else both of latest/ where the address ends in a date. fetch gives None for what isn't there."""
    url = url.rstrip("/")
    head, _, day = url.rpartition("/")
    for at in [url] + ([f"{head}/latest"] if day.isdigit() else []):
        for name, parse in (("/dumpstatus.json", parts_from_status), ("/", parts_from_html)):
            body = fetch(at + name)
            found = parse(spark, body, at) if body else None
            if found is not None and not found.isEmpty():
                return found
    raise LookupError(f"no history files at {url}")


def download(url: str, folder: str, opener: Callable = urllib.request.urlopen) -> str:
    """A file staged once; one that is there and not empty is used again."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, url.rstrip("/").rpartition("/")[2])
    if os.path.exists(path) and os.path.getsize(path):
        return path
    with opener(url) as source, open(path + ".part", "wb") as sink:
        shutil.copyfileobj(source, sink, 1 << 20)
    os.replace(path + ".part", path)
    return path


INSTANCE = (
    "_Id int, _InstanceType string, _RevisionId long, TimeStamp struct<CreationDate:string,LastEditDate:string,LastActivityDate:string,CommunityOwnedDate:string,ClosedDate:string>, "
    "Contributors struct<OwnerUserName:string,OwnerUserId:long,LastEditorUserId:long>, EditDetails struct<EditType:string>, "
    "Body struct<Title:string,Text:struct<_Type:string,_Bytes:long,_VALUE:string>>, Tags string, "
    "Credit struct<Score:string,CommentCount:string,ViewCount:string,AnswerCount:string,FavouriteCount:string>, Knowl struct<_key:string,_VALUE:string>"
)


def knolml(spark: SparkSession, path: str) -> DataFrame:
    """Instances of KnolML files, nested as they stand."""
    return spark.read.format("xml").schema(INSTANCE).option("rowTag", "Instance").option("ignoreSurroundingSpaces", "false").option("attributePrefix", "_").load(path)


def knolml_accessors(instances: DataFrame) -> DataFrame:
    """The flat columns of instances: editor, title, times, score, text, bytes, tags, type flags."""
    from palimspark.functions import text as t

    kind = F.col("_InstanceType")
    return instances.select(
        F.col("_Id").alias("id"), F.col("_RevisionId").alias("revid"), F.coalesce("Contributors.OwnerUserName", F.col("Contributors.OwnerUserId").cast("string")).alias("editor"),
        F.col("Body.Title").alias("title"), iso_to_ts(F.col("TimeStamp.CreationDate")).alias("created"), F.col("Credit.Score").try_cast("int").alias("score"),
        F.coalesce("Body.Text._VALUE", F.lit("")).alias("text"), F.coalesce("Body.Text._Bytes", F.length("Body.Text._VALUE").cast("long"), F.lit(0)).alias("bytes"), t.tags(F.col("Tags")).alias("tags"),
        t.is_type(kind, "Question").alias("is_question"), t.is_type(kind, "Answer").alias("is_answer"), t.is_type(kind, "Comments").alias("is_comment"), t.is_closed(F.col("TimeStamp.ClosedDate")).alias("is_closed"),
    )


def write_knolml(revisions: DataFrame, path: str) -> None:
    """Revision rows as KnolML instances, in order within a page; ids run from 1."""
    x = revisions.repartition("page_id").sortWithinPartitions("page_id", "idx").select(
        (F.col("idx") + 1).alias("_Id"), F.lit("Revision/Wiki").alias("_InstanceType"), F.col("revid").alias("_RevisionId"),
        F.struct(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".0")).alias("CreationDate")).alias("TimeStamp"),
        F.struct(F.struct(F.lit("wiki").alias("_Type"), F.col("size").alias("_Bytes"), F.col("text").alias("_VALUE")).alias("Text")).alias("Body"),
    )
    x.write.mode("overwrite").format("xml").option("rowTag", "Instance").option("rootTag", "KnolML").option("attributePrefix", "_").save(path)


def write_xml(revisions: DataFrame, path: str, codec: str = "bzip2") -> None:
    """Revision rows as export files, a page with all its revisions in one row; several files where there are many pages."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = F.struct("idx", F.col("revid").alias("id"), stamp.alias("timestamp"), F.struct(F.octet_length("text").alias("_bytes"), F.col("text").alias("_VALUE")).alias("text"))
    pages = revisions.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("r"))
    pages = pages.select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("title"), F.lit(0).alias("ns"), F.col("page_id").alias("id"),
        F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["timestamp"].alias("timestamp"), x["text"].alias("text"))).alias("revision"),
    )
    pages.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").option("attributePrefix", "_").option("compression", codec).save(path)
