"""Commands: python -m palimspark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import datetime
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimspark.functions.text import id_list
from palimspark.operators import analytics, compress, joins, retrieve
from palimspark.plans import sweep
from palimspark.sources import api, dumps, store


WIKI = "https://" + "en.wikipedia.org/w/api.php"
_MUST = object()
_FLAG = object()
_SOLVER = {"time_budget": None, "solver": "heuristic", "eps": 0.1, "max_states": 100_000}
_KINDS = {n: int for n in ("time_budget", "limit", "limit_revs", "max_pages_scan", "count", "start", "length", "max_states")} | {"eps": float}
#: What each command takes, with defaults; with a strategy where it compresses.
COMMANDS: dict[str, dict] = {
    "compress-api": {"title": _MUST, "limit": 50, "out": _MUST, "url": WIKI, "user_agent": "palimspark", "recorded": None, "strategy": "auto"} | _SOLVER,
    "compress-from-dump": {"dump": _MUST, "titles": "", "page_ids": "", "out_dir": _MUST, "download_dir": "dumps", "limit_revs": None, "user_agent": "palimspark", "strategy": "auto"} | _SOLVER,
    "compress-from-dump-dir": {"dump_dir": _MUST, "page_ids": _MUST, "out_dir": _MUST, "index": None, "pattern": "*.bz2", "max_pages_scan": None, "resume": _FLAG, "force": _FLAG, "strategy": "fptas"} | _SOLVER,
    "compress-xml": {"xml": _MUST, "title": _MUST, "count": 200, "out": _MUST, "strategy": "auto"} | _SOLVER,
    "compress-from-history-file": {"file": _MUST, "page_ids": _MUST, "out_dir": _MUST, "limit_revs": None, "strategy": "auto"} | _SOLVER,
    "retrieve": {"in": _MUST, "start": _MUST, "length": 0, "print": _FLAG},
    "retrieve-by-id": {"in": _MUST, "ids": _MUST, "print": _FLAG},
    "retrieve-by-time": {"in": _MUST, "start_ts": None, "end_ts": None, "print": _FLAG},
    "debug-resolve": {"dump": _MUST, "titles": _MUST},
    "build-index": {"file": _MUST, "index": _MUST},
    "analyze-comp": {"in_dir": _MUST, "out_csv": _MUST, "plots_dir": None},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimspark")
    sub = p.add_subparsers(dest="command", required=True)
    for command, options in COMMANDS.items():
        c = sub.add_parser(command)
        for name, default in options.items():
            how = {"dest": "path" if name == "in" else name}
            if default is _FLAG:
                how["action"] = "store_true"
            else:
                how |= {"type": _KINDS.get(name, str), "required": True} if default is _MUST else {"type": _KINDS.get(name, str), "default": default}
            c.add_argument("--" + name.replace("_", "-"), **how)
    return p


def _http(agent: str):
    import urllib.error
    import urllib.request

    def fetch(url: str) -> str | None:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=60) as r:
                return r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as error:
            if error.code == 404:
                return None
            raise

    return fetch


def _solver(a: argparse.Namespace) -> dict:
    return {"time_budget": a.time_budget, "solver": a.solver, "strategy": a.strategy, "eps": a.eps, "max_states": a.max_states}


def _dump_parts(spark: SparkSession, a: argparse.Namespace, api_url: str):
    agent = getattr(a, "user_agent", "palimspark")
    titles = [t for t in map(str.strip, a.titles.split(",")) if t]
    found = api.resolve(titles, lambda ask: api.fetch_http(api_url, ask, agent)) if titles else {}
    ids = list(found.values()) + id_list(getattr(a, "page_ids", ""))
    parts = dumps.list_parts(spark, a.dump, _http(agent))
    wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "page_id long")
    ranges = parts.withColumnsRenamed({"start": "lo", "end": "hi"})
    return found, joins.first_covering(wanted, ranges, ["part", "lo", "hi"])


def run(argv: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("palimspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    say = lambda *x: print(*x, file=out)

    def write_one(revisions, title: str, path: str) -> int:
        if revisions.isEmpty():
            say("no revisions")
            return 1
        folder, name = os.path.split(path)
        named = revisions.select("page_id").distinct().withColumn("title", F.lit(title))
        rows = compress.compress(revisions.select("page_id", "idx", "revid", "ts", "text", "size"), **_solver(a))
        told = {k: _solver(a)[k] for k in ("time_budget", "solver", "strategy")}
        (written,) = store.save(compress.artifacts(rows, named, **told), folder or ".").collect()
        if written.error:
            say(written.error)
            return 1
        os.replace(written.artifact, path)
        say(f"wrote {path}")
        return 0

    if a.command == "compress-api":
        extra = {"recorded": a.recorded} if a.recorded else {"url": a.url, "agent": a.user_agent}
        x = api.load(spark, [a.title], a.limit, **extra)
        from palimspark.functions.times import iso_to_ts

        x = x.select("page_id", "idx", "revid", iso_to_ts(F.col("timestamp")).alias("ts"), "text", F.length("text").cast("long").alias("size"))
        return write_one(x, a.title, a.out)
    if a.command == "compress-xml":
        return write_one(dumps.history(spark, a.xml, title=a.title, limit=a.count), a.title, a.out)
    if a.command == "compress-from-history-file":
        x = dumps.revisions(dumps.xml_pages(spark, a.file), id_list(a.page_ids), limit_per_page=a.limit_revs)
        titles = x.groupBy("page_id").agg(F.first("title").alias("title"))
        say(sweep.save_pages(x, a.out_dir, titles, a.file, **_solver(a)).count(), "pages")
        return 0
    if a.command == "compress-from-dump":
        _, places = _dump_parts(spark, a, WIKI)
        rows = places.select("page_id", "url").collect()  # what the command line asked for
        files = {url: dumps.download(url, a.download_dir) for url in dict.fromkeys(r.url for r in rows)}
        x = dumps.revisions(dumps.xml_pages(spark, list(files.values())), [r.page_id for r in rows], limit_per_page=a.limit_revs)
        titles = x.groupBy("page_id").agg(F.first("title").alias("title"))
        now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
        store.write_manifest(sweep.save_pages(x, a.out_dir, titles, a.dump, **_solver(a)), os.path.join(a.out_dir, "manifest"), {"dump": a.dump, "generated_at": now})
        return 0
    if a.command == "compress-from-dump-dir":
        index = dumps.load_index(spark, a.index) if a.index and os.path.exists(a.index) else dumps.index_dir(spark, a.dump_dir, a.pattern)
        if a.index and not os.path.exists(a.index):
            dumps.save_index(index, a.index)
        rows = sweep.sweep(spark, a.dump_dir, id_list(a.page_ids), a.out_dir, a.pattern, index, a.resume, a.force, max_pages=a.max_pages_scan, **_solver(a))
        store.write_manifest(rows, os.path.join(a.out_dir, "manifest"))
        return 0
    if a.command == "debug-resolve":
        found, places = _dump_parts(spark, a, WIKI)
        for title, page in found.items():
            say(page, title)
        for r in places.orderBy("page_id").collect():
            say(r.page_id, r.fname)
        return 0
    if a.command == "build-index":
        dumps.page_index(spark, a.file).write.mode("overwrite").parquet(a.index)
        say(spark.read.parquet(a.index).count(), "pages")
        return 0
    if a.command == "analyze-comp":
        pages = analytics.summarize_artifacts(store.load(spark, a.in_dir), F.element_at(F.split(F.col("file"), "/"), -1))
        store.write_csv(pages.orderBy("artifact"), a.out_csv)
        if a.plots_dir:
            lengths = store.load(spark, a.in_dir).select(F.explode("meta.chain_lengths").alias("chain_len"))
            store.write_csv(analytics.histogram(lengths, "chain_len"), os.path.join(a.plots_dir, "chain_lengths"))
            store.write_csv(analytics.tradeoff_points(pages), os.path.join(a.plots_dir, "tradeoff"))
        for r in analytics.corpus_aggregate(pages).collect():
            for k, v in r.asDict().items():
                say(f"{k}: {v}")
        return 0
    rows = compress.explode(store.load(spark, a.path))
    if a.command == "retrieve":
        page = rows.select("page_id").first()
        got = retrieve.checked_range(rows, page.page_id, a.start, a.length)
    elif a.command == "retrieve-by-id":
        got = retrieve.by_revid(rows, retrieve.request(spark, id_list(a.ids, strict=True))).orderBy("pos")
    else:
        got = retrieve.by_time(rows, a.start_ts, a.end_ts)
    got = got if "pos" in got.columns else got.orderBy("idx")
    for r in got.toLocalIterator():
        say(r.text if a.print else f"{r.idx}\t{len(r.text)}")
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
