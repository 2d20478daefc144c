"""Browsing folders page by page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decode_cursor, encode_cursor, has_prefix, normalize_path
from ..schema import NOT_FOUND, OK


def listing(files: DataFrame, folder: str) -> DataFrame:
    """(kind, path, name): sub-folders from distinct parents, then files; the prefix is a range that prunes the scan."""
    folder = normalize_path(folder)
    prefix = "/" if folder == "/" else folder + "/"
    live = files.filter(F.col("deleted_at").isNull())
    own = live.filter(F.col("parent_dir") == folder).select(F.lit("file").alias("kind"), "path", F.substring_index("path", "/", -1).alias("name"))
    below = live.filter(has_prefix(F.col("parent_dir"), prefix)).select("parent_dir").distinct()
    name = F.substring_index(F.substring("parent_dir", len(prefix) + 1, 1 << 20), "/", 1)
    dirs = below.select(name.alias("name")).filter("name <> ''").distinct().select(F.lit("dir").alias("kind"), F.concat(F.lit(prefix), "name").alias("path"), "name")
    return dirs.unionByName(own)


@dataclass
class Page:
    status: str
    rows: DataFrame | None
    next_cursor: str


def page_size(n: int) -> int:
    return 50 if n <= 0 else min(n, 500)


def browse_rows(files: DataFrame, folder: str, cursor: str = "", size: int = 50) -> DataFrame:
    return listing(files, folder).orderBy("path", "kind").offset(decode_cursor(cursor)).limit(page_size(size))


def browse(files: DataFrame, folder: str, cursor: str = "", size: int = 50) -> Page:
    """A page and the cursor of the next, if there is one. A folder without anything is not found, the root excepted."""
    start, n = decode_cursor(cursor), page_size(size)
    rows = listing(files, folder).orderBy("path", "kind").offset(start).limit(n + 1)
    found = rows.count()
    if not found and not start and normalize_path(folder) != "/":
        return Page(NOT_FOUND, None, "")
    return Page(OK, rows.limit(n), encode_cursor(start + n) if found > n else "")
