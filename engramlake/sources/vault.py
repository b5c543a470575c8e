"""Vaults: folders of Markdown pages with front matter, read, compared and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str) -> DataFrame:
    """file and content of every Markdown page under a folder; hidden folders, placeholders and empty pages are left out."""
    x = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    x = x.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return x.filter(F.col("content").rlike(r"\S") & ~F.col("file").rlike(r"/\.[^/]+/") & ~F.col("file").rlike(r"/_[^/]*\.md$"))


def front(content: Column) -> Column:
    """The front matter between the two lines of dashes; empty without one."""
    return F.regexp_extract(content, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)


def body(content: Column) -> Column:
    return F.regexp_replace(content, r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)", "")


def fields(content: Column) -> Column:
    """The plain `key: value` lines of the front matter as a map; of a key that repeats, the first counts."""
    lines = F.filter(F.split(front(content), r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    keys = F.transform(lines, lambda x: F.substring_index(x, ":", 1))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\"'](.*)[\"']$", "$1")
    first = F.array_distinct(keys)
    return F.map_from_arrays(first, F.transform(first, lambda k: F.element_at(F.transform(lines, value), F.array_position(keys, k).cast("int"))))


def rendered(pages: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """slug and content of each page (slug, title, type, body) with its tags (slug, tag) and links (src, dst, link_type)."""
    t = tags.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))
    out = links.select(F.col("src").alias("slug"), F.concat(F.lit("[["), "link_type", F.lit(":"), "dst", F.lit("]]")).alias("l"))
    l = out.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("l")), "\n").alias("links"))  # noqa: E741
    x = pages.join(t, "slug", "left").join(l, "slug", "left")
    head = F.concat(
        F.lit("---\ntitle: "), F.coalesce("title", F.lit("")), F.lit("\ntype: "), F.coalesce("type", F.lit("")),
        F.lit("\ntags: ["), F.coalesce("tags", F.lit("")), F.lit("]\n---\n"),
    )
    foot = F.when(F.col("links").isNotNull(), F.concat(F.lit("\n"), "links")).otherwise("")
    return x.select("slug", F.concat(head, F.coalesce("body", F.lit("")), foot).alias("content"))


def export_plan(rendered_pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """write, skip or remove for each slug of the pages and of the manifest (slug, hash)."""
    now = rendered_pages.select("slug", F.sha2("content", 256).alias("now"))
    x = now.join(manifest.select("slug", F.col("hash").alias("was")), "slug", "full")
    step = F.when(F.col("now").isNull(), "remove").when(F.col("now").eqNullSafe(F.col("was")), "skip").otherwise("write")
    return x.select("slug", step.alias("step"))


def import_plan(files: DataFrame, store: DataFrame, manifest: DataFrame) -> DataFrame:
    """For each file (slug, hash): create, skip, update, or conflict where the store moved on from the manifest as well."""
    x = files.select("slug", F.col("hash").alias("file")).join(store.select("slug", F.col("hash").alias("stored")), "slug", "left")
    x = x.join(manifest.select("slug", F.col("hash").alias("was")), "slug", "left")
    step = F.when(F.col("stored").isNull(), "create").when((F.col("file") == F.col("stored")) | F.col("file").eqNullSafe(F.col("was")), "skip")
    return x.select("slug", step.when(F.col("stored").eqNullSafe(F.col("was")), "update").otherwise("conflict").alias("step"))


def write(rendered_pages: DataFrame, path: str) -> None:
    """Pages as JSON lines, in a folder for each first part of a slug."""
    part = F.substring_index("slug", "/", 1).alias("folder")
    rendered_pages.select("slug", "content", part).write.mode("overwrite").partitionBy("folder").json(path)
