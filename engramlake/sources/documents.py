"""Documents to be read: their addresses, the walks that find them, and the one list that comes of all walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The host of addresses, and the folders of documents that are not read.
HOST = r"feishu\.[a-z]+"
UNSUPPORTED = ("docs", "sheets", "base", "mindnotes", "file", "slides")
RAW_TOKEN = "^[A-Za-z0-9]{20,}$"
#: What a walk gives of each document, the columns of a list of candidates.
COLUMNS = ("doc_token", "title", "origin", "parent_path", "url", "owner", "modified_s")


def address(value: Column, host: str = HOST) -> Column:
    """(kind, token, code) of an address or a bare token: a docx, a wiki_node, or reject with UNSUPPORTED_DOC_TYPE or INVALID_URL; null is invalid. The first form that fits counts."""
    x = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    docx, wiki = (F.regexp_extract(x, f"{host}/{part}/([^/?#]+)", 1) for part in ("docx", "wiki"))
    none = F.lit(None).cast("string")

    def found(kind: str, token: Column, code: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), token.alias("token"), code.alias("code"))

    return (
        F.when(x.rlike(RAW_TOKEN), found("docx", x, none)).when(docx != "", found("docx", docx, none)).when(wiki != "", found("wiki_node", wiki, none))
        .when(x.rlike(f"{host}/({'|'.join(UNSUPPORTED)})/"), found("reject", none, F.lit("UNSUPPORTED_DOC_TYPE"))).otherwise(found("reject", none, F.lit("INVALID_URL")))
    )


def in_folders(files: DataFrame, folders: DataFrame, origin: str) -> DataFrame:
    """The documents among files (token, name, type, folder, url, owner, modified_s) that lie in the folders of a walk (token, path)."""
    at = folders.select(F.col("token").alias("folder"), F.col("path").alias("parent_path"))
    x = files.filter("type = 'docx'").join(at, "folder")
    return x.select(F.col("token").alias("doc_token"), F.col("name").alias("title"), F.lit(origin).alias("origin"), "parent_path", "url", "owner", "modified_s")


def in_wiki(nodes: DataFrame, spaces: DataFrame, excluded: DataFrame) -> DataFrame:
    """The documents among the nodes (space_id, obj_token, obj_type, title, url, owner, modified_s) of all wiki spaces (space_id, name) but the excluded ones."""
    seen = spaces.join(excluded.select("space_id"), "space_id", "left_anti")
    x = nodes.filter("obj_type = 'docx'").join(seen, "space_id")
    return x.select(F.col("obj_token").alias("doc_token"), "title", F.lit("wiki").alias("origin"), F.concat(F.lit("Wiki/"), "name", F.lit("/")).alias("parent_path"), "url", "owner", "modified_s")


def united(walks: list[DataFrame]) -> DataFrame:
    """Each document once, as the first walk that has it gives it; of one walk the least path, then the least title. Partial minima go before the shuffle, so a document that all walks find is no hot key. Rows without a token are left out."""
    each = [w.select(F.lit(k).alias("_walk"), *COLUMNS) for k, w in enumerate(walks)]
    rest = [c for c in COLUMNS if c not in ("doc_token", "parent_path", "title")]
    first = F.min(F.struct("_walk", "parent_path", "title", *rest)).alias("f")
    x = reduce(DataFrame.unionByName, each).filter("doc_token IS NOT NULL").groupBy("doc_token").agg(first)
    return x.select("doc_token", *[F.col(f"f.{c}").alias(c) for c in COLUMNS if c != "doc_token"])
