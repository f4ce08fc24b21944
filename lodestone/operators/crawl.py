"""Crawling over a table of pages: a frontier that joins, level by level."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.store import written


def crawl(pages: DataFrame, seeds: Sequence[str], depth: int = 2, most: int | None = None, same_domain: bool = True, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """(url, depth, html columns of pages) reached from the seeds within ``depth`` links.

    pages (url, html); URLs are compared in their normal form.  Each level is one join of the
    frontier (written, so that no level is computed again) with the pages and one against what was
    visited; links to pages that the table
    lacks lead nowhere.  With ``same_domain`` links stay in the first seed's domain."""
    spark = pages.sparkSession
    known = pages.withColumn("key", T.url_normal(F.col("url"))).dropDuplicates(["key"])
    home = T.domain(F.lit(seeds[0]))
    frontier = spark.createDataFrame([(s,) for s in seeds], "seed string").select(T.url_normal(F.col("seed")).alias("key")).distinct()
    levels: list[DataFrame] = []
    visited = None
    for level in range(depth + 1):
        frontier = written(frontier, "frontier")
        here = known.join(frontier, "key", "left_semi").withColumn("depth", F.lit(level))
        levels.append(here)
        visited = frontier if visited is None else visited.unionByName(frontier)
        if level == depth:
            break
        links = here.select(F.explode(T.html_links(F.col("html"), F.col("url"))).alias("link"))
        domain = home if same_domain else T.domain(F.col("link"))
        wanted = links.where(T.wanted_url(F.col("link"), domain, list(include), list(exclude)))
        frontier = wanted.select(T.url_normal(F.col("link")).alias("key")).distinct().join(visited, "key", "left_anti")
    found = reduce(DataFrame.unionByName, levels).drop("key")
    return found if most is None else found.orderBy("depth", "url").limit(most)


def crawl_stats(found: DataFrame, type_col: str | None = None) -> DataFrame:
    """One row: pages, bytes, pages by depth and by content type."""
    kind = F.col(type_col) if type_col else T.content_type(F.col("url"), F.lit(None).cast("string"))
    rows = found.select("depth", F.octet_length("html").alias("bytes"), kind.alias("kind"))
    # one line for each depth and type
    cube = rows.groupBy("depth", "kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    depths, kinds = (cube.groupBy(c).agg(F.sum("n").alias("n")).agg(by(c).alias(name)) for c, name in (("depth", "by_depth"), ("kind", "by_type")))
    total = cube.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pages"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    # one row each by construction
    return total.crossJoin(F.broadcast(depths)).crossJoin(F.broadcast(kinds))
