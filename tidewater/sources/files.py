"""Folders as tables: walking, hashing, classifying, tool and resource scans."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.scalars import content_class, content_hash, extension, is_binary, matches_globs, mime_of, parent_dir
from ..operators.tools import TOOL, tools_of

#: Fixed values.
PRUNED = (".git", "node_modules", "__pycache__", ".venv", "venv", "target", "dist", "build", ".tidewater")
MOST_BYTES, MOST_RESOURCE, MOST_HASHED, SAMPLE = 32 << 20, 50 << 20, 1 << 30, 8192
CODE = (".py", ".ts", ".js", ".sh")
RESOURCES = {
    ".pdf": ("application/pdf", "document"), ".md": ("text/markdown", "document"), ".txt": ("text/plain", "document"), ".doc": ("application/msword", "document"),
    ".docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "document"), ".png": ("image/png", "image"), ".jpg": ("image/jpeg", "image"), ".jpeg": ("image/jpeg", "image"),
    ".svg": ("image/svg+xml", "image"), ".gif": ("image/gif", "image"), ".csv": ("text/csv", "data"), ".json": ("application/json", "data"), ".parquet": ("application/octet-stream", "data"),
    ".xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "data"), ".yaml": ("text/yaml", "config"), ".yml": ("text/yaml", "config"), ".toml": ("text/toml", "config"),
}
TEXT_MIMES = ("application/json", "text/csv", "text/markdown", "text/plain", "text/yaml", "text/toml", "image/svg+xml", "application/xml")


def local_path(path: Column) -> Column:
    return F.regexp_replace(path, "^[a-z0-9+]+:/*(?=/)", "")


def root_path(root: str) -> str:
    """A root as the paths of its files have it: without scheme, with a slash at the end."""
    return re.sub(r"^[a-z0-9+]+:/*(?=/)", "", root).rstrip("/") + "/"


#: How Hadoop writes a file's status: one call for each.
_STATUS = re.compile(r"path=(.*?); isDirectory=(true|false); (?:length=(\d+); replication=\d+; blocksize=\d+; )?modification_time=(\d+);")


def _statuses(spark: SparkSession, folder: str) -> list[tuple[str, bool, int, int]]:
    """Path, whether it is a folder, length and time of change (ms) of what a folder holds, or of one file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    rows = []
    for f in found:
        m = _STATUS.search(f.toString())
        rows.append((m[1], m[2] == "true", int(m[3] or 0), int(m[4])) if m else (f.getPath().toString(), f.isDirectory(), f.getLen(), f.getModificationTime()))
    return rows


def unseen(spark: SparkSession, root: str | list[str]) -> list[tuple[str, int, int]]:
    """Path, length and time of change (ms) of the files that Spark's sources pass over, as their name or a folder's below the root begins with _ or a dot.

    Folders are listed by the driver, as Spark's own listing is; pruned folders and links to folders are not entered.
    """
    if not isinstance(root, str):
        return [(p, n, t) for f in root if f.rsplit("/", 1)[-1][:1] in "_." for p, _, n, t in _statuses(spark, f)]
    out, todo = [], [(root, False)]
    while todo:
        folder, below = todo.pop()
        for path, is_folder, length, changed in _statuses(spark, folder):
            name = path.rstrip("/").rsplit("/", 1)[-1]
            hidden = below or name[:1] in "_."
            if not is_folder:
                out += [(path, length, changed)] if hidden else []
            elif name not in PRUNED and not os.path.islink(re.sub("^file:/*(?=/)", "", path)):
                todo.append((path, hidden))
    return out


@F.pandas_udf(BinaryType())
def _content(paths: pd.Series) -> pd.Series:
    from pyarrow.fs import FileSystem

    def read(path: str) -> bytes:
        fs, where = FileSystem.from_uri(re.sub("^file:/*(?=/)", "", path))
        with fs.open_input_file(where) as f:
            return f.read()

    return paths.map(read)


def raw_files(spark: SparkSession, root: str | list[str], ignore: list[str] = (), include_dotenv: bool = False, most: int | None = None) -> DataFrame:
    """path, length, modificationTime, content of every file below a folder, or of listed files.

    Pruned folders and dot-files are left out. Files over ``most`` bytes are left out by the source, before it opens them;
    where content isn't selected, no file is opened.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if hidden := unseen(spark, root):
        more = spark.createDataFrame(hidden, "path string, length long, ms long")
        rows = rows.unionByName(more.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", _content("path").alias("content")))
    if most is not None:
        rows = rows.filter(F.col("length") <= most)
    path = local_path(F.col("path"))
    name = F.substring_index(path, "/", -1)
    pruned = "|".join(p.replace(".", "[.]") for p in PRUNED)
    keep = ~path.rlike(f"/({pruned})/") & (~name.startswith(".") | ((name == ".env") if include_dotenv else F.lit(False)))
    return rows.filter(keep & matches_globs(name, [], list(ignore))).withColumn("path", path)


def walk(spark: SparkSession, root: str, run_start: int, ignore: list[str] = (), include_dotenv: bool = False) -> DataFrame:
    """Rows for the files table (without file_id). Contents are hashed; the class comes from the path and a sample.

    A file over 1 GiB isn't opened: its hash is that of its path, length and time of change, its class that of its path.
    """
    sample = F.substring("content", 1, SAMPLE)
    mime = mime_of(sample)
    rows = raw_files(spark, root, ignore, include_dotenv, MOST_HASHED)
    opened = rows.select("path", "length", "modificationTime", F.unhex(content_hash(F.col("content"))).alias("sha256"), mime.alias("mime"), content_class(F.col("path"), mime, sample).alias("content_class"))
    large = raw_files(spark, root, ignore, include_dotenv).filter(F.col("length") > MOST_HASHED)
    stat = F.concat_ws(" ", "path", F.col("length").cast("string"), F.unix_timestamp("modificationTime").cast("string"))
    closed = large.select("path", "length", "modificationTime", F.unhex(content_hash(stat)).alias("sha256"), F.lit("application/octet-stream").alias("mime"), content_class(F.col("path")).alias("content_class"))
    return opened.unionByName(closed).select(
        "path", "sha256", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "mime", "content_class", parent_dir(F.col("path")).alias("parent_dir"),
        F.lit(run_start).cast("long").alias("last_seen"), F.lit(None).cast("long").alias("deleted_at"),
    )


def contents(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(path, text, failure): text of files up to 32 MiB, a reason for the others, which aren't opened."""
    small = raw_files(spark, root, most=MOST_BYTES).withColumn("failure", F.when(is_binary(F.col("content")), "binary_content_detected"))
    texts = small.select("path", F.when(F.col("failure").isNull(), F.decode("content", "UTF-8")).alias("text"), "failure")
    large = raw_files(spark, root).filter(F.col("length") > MOST_BYTES)
    return texts.unionByName(large.select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("file too large: "), F.col("length").cast("string")).alias("failure")))


def scan_tools(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """name, source_file, description, input_schema, risk, language, content_hash of every tool below a folder."""
    base = root_path(root)
    rows = raw_files(spark, root, most=MOST_BYTES)
    rows = rows.filter(matches_globs(F.substring(F.col("path"), len(base) + 1, 1 << 20), list(include), list(exclude)))

    @F.pandas_udf(TOOL)
    def extract(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([tools_of(p, t or "") for p, t in zip(path, text)])

    return rows.select("path", F.explode(extract("path", F.decode("content", "UTF-8"))).alias("t"), content_hash(F.col("content"), True).alias("content_hash")).select("t.name", F.col("path").alias("source_file"), "t.description", "t.input_schema", "t.risk", "t.language", "content_hash")


def scan_resources(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """name, file_path, mime_type, size_bytes, resource_type of known kinds up to 50 MiB; no code, no .env files."""
    base = root_path(root)
    rows = raw_files(spark, root, most=MOST_RESOURCE)
    rows = rows.filter(matches_globs(F.substring(F.col("path"), len(base) + 1, 1 << 20), list(include), list(exclude)) & ~F.substring_index("path", "/", -1).startswith(".env"))
    kinds = F.broadcast(spark.createDataFrame([(k, *v) for k, v in RESOURCES.items() if k not in CODE], "ext string, mime_type string, resource_type string"))
    return rows.withColumn("ext", F.lower(extension(F.col("path")))).join(kinds, "ext").select(F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("file_path"), "mime_type", F.col("length").alias("size_bytes"), "resource_type")


def read_resource(rows: DataFrame) -> DataFrame:
    """(name, body): text as it is, anything else in base64."""
    return rows.select("name", F.when(F.col("mime_type").isin(*TEXT_MIMES), F.decode("content", "UTF-8")).otherwise(F.base64("content")).alias("body"))
