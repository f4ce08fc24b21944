"""Pages from servers: a data source of given URLs, a fetcher for tables of URLs, a live crawl."""

from __future__ import annotations

import http.client
import json
import socket
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from functools import reduce
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions import text as T
from lodestone.sources.store import written

DDL = "url string, final_url string, status int, content_type string, content binary, error string, fetched_at timestamp"
_SCHEMA = pa.schema([("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("content", pa.binary()), ("error", pa.string()), ("fetched_at", pa.timestamp("us", "UTC"))])


class Manner(NamedTuple):
    """How a server is asked: seconds between two requests to a host, seconds to wait for an
    answer, the most bytes of a page (longer ones are errors), tries after a broken connection."""

    delay: float = 0.5
    timeout: float = 30.0
    most_bytes: int = 10 * 1024 * 1024
    retries: int = 1
    agent: str = "lodestone-crawler"


def _kind_of(e: BaseException) -> str:
    """timeout, tls or connection, whatever the error is wrapped in."""
    reason = getattr(e, "reason", e)
    if isinstance(reason, (TimeoutError, socket.timeout)):
        return "timeout"
    return "tls" if isinstance(reason, ssl.SSLError) else "connection"


def fetch_one(url: str | None, manner: Manner) -> tuple:
    """One row of DDL for a URL; whatever goes wrong is its ``error``, never an exception.

    Errors: ``scheme`` (neither http nor https, or no host), ``http <status>``, ``timeout``,
    ``tls``, ``too long`` and ``connection``.  Redirects are followed, ``final_url`` is where they end."""
    at = datetime.now(UTC)
    try:
        parts = urlsplit(url or "")
        known = parts.scheme.lower() in ("http", "https") and bool(parts.hostname)
    except ValueError:
        known = False
    if not known:
        return (url, None, None, None, None, "scheme", at)
    for left in range(manner.retries, -1, -1):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": manner.agent})
            with urllib.request.urlopen(request, timeout=manner.timeout) as answer:
                body = answer.read(manner.most_bytes + 1)
                kind = answer.headers.get("Content-Type")
                if len(body) > manner.most_bytes:
                    return (url, answer.url, answer.status, kind, None, "too long", at)
                return (url, answer.url, answer.status, kind, body, None, at)
        except urllib.error.HTTPError as e:
            e.close()
            return (url, e.url, e.code, e.headers.get("Content-Type"), None, f"http {e.code}", at)
        except (OSError, http.client.HTTPException, ValueError) as e:
            if _kind_of(e) != "connection" or not left:
                return (url, None, None, None, None, _kind_of(e), at)
            time.sleep(manner.delay)
    raise AssertionError("unreachable")


def _in_turn(urls: Iterator[tuple[str, str | None]], manner: Manner) -> Iterator[tuple]:
    """The rows of (host, url) in order; a pause between two requests to one host."""
    last: tuple[str, float] | None = None
    for host, url in urls:
        if last and last[0] == host:
            time.sleep(max(0.0, last[1] + manner.delay - time.monotonic()))
        last = (host, time.monotonic())
        yield fetch_one(url, manner)


def fetch(urls: DataFrame, manner: Manner = Manner()) -> DataFrame:
    """Rows of DDL for each distinct URL of ``urls`` (url).

    A host's URLs are in one task, one after another, so that no host is asked twice at a
    time; a page leaves the task as soon as a batch holds 8 MB.  Fetching is no function of its
    input: write the result before using it twice.  A host of very many URLs takes as long as
    its delay says, as it must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = ((h or "", u) for b in batches for h, u in zip(b.column("host").to_pylist(), b.column("url").to_pylist(), strict=True))
        kept: list[tuple] = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
        for row in _in_turn(asked, manner):
            kept.append(row)
            size += len(row[4] or b"") + 1000
            if size > 8 << 20:
                yield pack()
                kept.clear()
                size = 0
        if kept:
            yield pack()

    hosts = urls.select("url").distinct().withColumn("host", T.domain(F.col("url")))
    return hosts.repartition("host").sortWithinPartitions("host", "url").mapInArrow(run, DDL)


class _Host(InputPartition):
    def __init__(self, host: str, urls: list[str]) -> None:
        self.host, self.urls = host, urls


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        given = {k.lower(): v for k, v in options.items()}
        urls = json.loads(given["urls"]) if "urls" in given else [given["path"]]
        self.manner = Manner(*(type(default)(given.get(name.replace("_", ""), default)) for name, default in zip(Manner._fields, Manner(), strict=True)))
        self.hosts: dict[str, list[str]] = {}
        for url in dict.fromkeys(urls):
            self.hosts.setdefault(_host(url), []).append(url)

    def partitions(self) -> Sequence[InputPartition]:
        return [_Host(h, u) for h, u in sorted(self.hosts.items())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _in_turn(((partition.host, u) for u in partition.urls), self.manner)


def _host(url: str) -> str:
    try:
        return urlsplit(url).netloc.lower()
    except ValueError:
        return ""


class Pages(DataSource):
    """``spark.read.format("lodestone_pages")``: rows of DDL, one partition a host.

    Options: ``urls``, a JSON list (or ``load(url)`` for one), and the fields of ``Manner``
    without underscores.  For seeds; tables of URLs go through ``fetch``."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_pages"

    def schema(self) -> str:
        return DDL

    def reader(self, schema: object) -> DataSourceReader:
        return _PagesReader(dict(self.options))


def read_pages(spark: SparkSession, urls: Sequence[str], manner: Manner = Manner()) -> DataFrame:
    """Rows of DDL for the URLs, through the data source."""
    spark.dataSource.register(Pages)
    asked = spark.read.format("lodestone_pages").option("urls", json.dumps(list(urls)))
    return reduce(lambda r, kv: r.option(kv[0].replace("_", ""), str(kv[1])), manner._asdict().items(), asked).load()


def crawl_live(spark: SparkSession, seeds: Sequence[str], depth: int = 2, most: int | None = None, same_domain: bool = True, include: Sequence[str] = (), exclude: Sequence[str] = (), manner: Manner = Manner()) -> DataFrame:
    """Rows of DDL and ``depth`` for what the seeds reach within ``depth`` links, errors included.

    As ``operators.crawl`` over a table: URLs are visited once in their normal form, a page
    that a redirect leads to counts as visited too, ``same_domain`` keeps to the first seed's domain.
    At most ``most`` URLs are asked, by depth and then URL.  A level is written before the next begins."""
    home = T.domain(F.lit(seeds[0]))
    frontier = spark.createDataFrame([(s,) for s in seeds], "link string").select(T.url_normal(F.col("link")).alias("url")).distinct()
    levels: list[DataFrame] = []
    left = most
    visited = None
    for level in range(depth + 1):
        if left is not None:
            frontier = frontier.orderBy("url").limit(left)
        here = written(fetch(frontier, manner).withColumn("depth", F.lit(level)), "fetched")
        levels.append(here)
        if left is not None:
            left -= here.count()
        if level == depth or left == 0:
            break
        seen = here.select(F.explode(F.array(T.url_normal(F.col("url")), T.url_normal(F.col("final_url")))).alias("url")).where("url is not null").distinct()
        visited = seen if visited is None else visited.unionByName(seen)
        html = F.expr("make_valid_utf8(cast(content as string))")
        pages = here.where("error is null").where(F.coalesce(F.lower("content_type"), F.lit("text/html")).contains("html")).select(html.alias("html"), "final_url")
        links = pages.select(F.explode(T.html_links(F.col("html"), F.col("final_url"))).alias("link"))
        domain = home if same_domain else T.domain(F.col("link"))
        wanted = links.where(T.wanted_url(F.col("link"), domain, list(include), list(exclude)))
        frontier = wanted.select(T.url_normal(F.col("link")).alias("url")).distinct().join(visited, "url", "left_anti")
        if left is None and frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def crawl_report(found: DataFrame) -> DataFrame:
    """(depth, outcome, pages, bytes): ``ok`` or the error, by depth."""
    outcome = F.coalesce(F.col("error"), F.lit("ok"))
    return found.groupBy("depth", outcome.alias("outcome")).agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
