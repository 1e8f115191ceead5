"""Revisions from a wiki's API as a Spark data source, one partition per title.

fetch(url, params) -> dict is injected where there is no network: the option
"recorded" names a JSON file of recorded answers, a list in the order asked per title.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SIZE = 500
RETRY = frozenset((500, 502, 503, 504))


def fetch_http(url: str, params: dict, agent: str, tries: int = 5, wait: float = 1.0) -> dict:
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers={"User-Agent": agent})
    for attempt in range(tries + 1):
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if error.code not in RETRY or attempt == tries:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


_QUERY = dict(action="query", format="json", formatversion="2")


def _pages(answer: dict) -> list[dict]:
    found = answer.get("query") or {}
    return found.get("pages") or []


def walk(title: str, limit: int, fetch: Callable[[dict], dict], pause: float = 0.0) -> Iterator[tuple]:
    """(title, page_id, idx, revid, timestamp, text), oldest first, up to limit; ValueError for an unknown title."""
    more: dict = {}
    idx = 0
    while idx < limit:
        ask = _QUERY | dict(prop="revisions", titles=title, rvdir="newer", rvslots="main", rvprop="ids|timestamp|content", rvlimit=min(limit - idx, PAGE_SIZE)) | more
        answer = fetch(ask)
        for page in _pages(answer):
            if page.get("missing"):
                raise ValueError(f"no page {title!r}")
            for r in page.get("revisions", []):
                if idx < limit:
                    main = (r.get("slots") or {}).get("main") or {}
                    yield title, page.get("pageid"), idx, r.get("revid", -1), r.get("timestamp", ""), main.get("content") or ""
                    idx += 1
        more = answer.get("continue") or {}
        if not more:
            return
        time.sleep(pause)


def resolve(titles: list[str], fetch: Callable[[dict], dict], batch: int = 50) -> dict[str, int]:
    """Page ids by normalised title, following redirects; unknown titles are left out."""
    out = {}
    for at in range(0, len(titles), batch):
        answer = fetch(_QUERY | dict(redirects=1, converttitles=1, titles="|".join(titles[at : at + batch])))
        for page in _pages(answer):
            if not page.get("missing") and "pageid" in page:
                out[page["title"]] = page["pageid"]
    return out


class WikiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki_api"

    def schema(self) -> str:
        return "title string, page_id long, idx int, revid long, timestamp string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Title(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Title(t) for t in json.loads(self.options["titles"])]

    def read(self, partition):
        o = self.options
        if "recorded" in o:
            answers = iter(json.load(open(o["recorded"], encoding="utf-8"))[partition.value])
            fetch = lambda ask: next(answers)
        else:
            fetch = lambda ask: fetch_http(o["url"], ask, o.get("agent", "palimspark"))
        yield from walk(partition.value, int(o.get("limit", "500")), fetch, float(o.get("pause", "0.1" if "url" in o else "0")))


def load(spark: SparkSession, titles: list[str], limit: int = 500, **options: str) -> DataFrame:
    spark.dataSource.register(WikiSource)
    return spark.read.format("wiki_api").options(titles=json.dumps(titles), limit=str(limit), **options).load()
