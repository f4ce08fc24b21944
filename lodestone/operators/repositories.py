"""Walks over tables of repository files: from each README along relative Markdown links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.sources.store import written


def repository_links(repo: Column, path: Column, text: Column) -> Column:
    """Distinct targets, as paths from the root, of a file's links to Markdown files.

    Relative links start at the file's folder, those that leave the root end at it; a link to a
    file's page counts if the page is of ``repo`` (owner/name), other URLs don't."""
    found = F.regexp_extract_all(text, F.lit(R.MARKDOWN_LINK), F.lit(1))
    folder = F.concat(F.lit("/"), F.regexp_replace(path, "[^/]*$", ""))
    page = r"^https?://(?:www\.)?github\.com/([^/]+/[^/]+)/blob/[^/]+/(.+)$"

    def target(link: Column) -> Column:
        own = F.regexp_extract(link, page, 1) == repo
        inside = F.when(link.startswith("/"), link).otherwise(F.concat(folder, link))
        return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(own, F.regexp_extract(link, page, 2))).otherwise(F.regexp_replace(T.without_dots(inside), "^/+", ""))

    return F.array_distinct(F.filter(F.transform(found, target), lambda t: t.isNotNull() & (t != "")))


def walk(files: DataFrame, depth: int = 2, most: int = 200) -> DataFrame:
    """(repo, path, depth, found) of what each repository's README reaches within ``depth`` links.

    files (repo, path, text).  The README is the first of the known names at the root that has
    text; repositories without one have no rows.  A file is visited once, at its least depth; links to
    files that are missing or empty are rows with ``found`` false.  At most ``most`` files
    are found in a repository, by depth and then path.  Rows of one path count as one file with
    the links of all of them; null repositories, paths and texts take no part.

    Texts are read once, for their links: the rounds join pairs of names."""
    has_text = files.where("repo is not null and path is not null and text <> ''")
    names = {name: i for i, name in enumerate(R.READMES)}
    keys = written(has_text.select("repo", "path").distinct(), "files")
    edges = written(has_text.select("repo", "path", F.explode(repository_links(F.col("repo"), F.col("path"), F.col("text"))).alias("target")).distinct(), "links")
    rank = reduce(lambda c, kv: c.when(F.col("path") == kv[0], kv[1]), names.items(), F.when(F.lit(False), 0))
    roots = keys.withColumn("rank", rank).where("rank is not null").groupBy("repo").agg(F.min_by("path", "rank").alias("path"))
    frontier, visited, taken = roots, None, None
    levels: list[DataFrame] = []
    for level in range(depth + 1):
        known = frontier.join(keys.withColumn("found", F.lit(True)), ["repo", "path"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
        by_path = Window.partitionBy("repo", "found").orderBy("path")
        # the constant bound prunes before the shuffle, the second knows what the repository has
        ranked = known.withColumn("rank", F.row_number().over(by_path)).where((F.col("rank") <= most) | ~F.col("found"))
        if taken is not None:
            ranked = ranked.join(taken, "repo", "left").where(~F.col("found") | (F.col("rank") + F.coalesce("n", F.lit(0)) <= most))
        here = written(ranked.select("repo", "path", F.lit(level).alias("depth"), "found"), "walked")
        levels.append(here)
        visited = reduce(DataFrame.unionByName, levels)
        if level == depth:
            break
        taken = visited.where("found").groupBy("repo").agg(F.count("*").alias("n"))
        linked = here.where("found").join(edges, ["repo", "path"]).select("repo", F.col("target").alias("path")).distinct()
        frontier = linked.join(visited.select("repo", "path"), ["repo", "path"], "left_anti")
    return visited


def walked_files(files: DataFrame, depth: int = 2, most: int = 200) -> DataFrame:
    """The rows of files that ``walk`` finds, with their depth."""
    return files.join(walk(files, depth, most).where("found").drop("found"), ["repo", "path"])


def chunked(files: DataFrame) -> DataFrame:
    """(repo, path, chunk_index, kind, content, indexable) of files (repo, path, text): source files by their blocks, others by sections.

    A source file without blocks is one chunk; null and blank texts have none; paths are unique within a repository."""
    key = F.concat_ws("\n", "repo", "path")
    rows = files.where(T.strip(F.col("text")) != "").withColumn("key", key)
    code = ~T.code_language(F.col("path")).isin("unknown", "markdown", "yaml", "json")
    blocks = C.code_chunks(rows.where(code), "key").select(F.col("path").alias("key"), "chunk_index", F.col("block_type").alias("kind"), "content", "indexable")
    parts = C.section_chunks(rows.where(~code), "key").select("key", "chunk_index", F.col("content_type").alias("kind"), "content", F.col("content").alias("indexable"))
    whole = rows.where(code).join(blocks.select("key").distinct(), "key", "left_anti").select("key", F.lit(0).alias("chunk_index"), F.lit("file").alias("kind"), F.col("text").alias("content"), F.col("text").alias("indexable"))
    names = [F.substring_index("key", "\n", 1).alias("repo"), F.substring_index("key", "\n", -1).alias("path")]
    return blocks.unionByName(parts).unionByName(whole).select(*names, "chunk_index", "kind", "content", "indexable")
