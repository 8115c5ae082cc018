"""Content manifests: path, size and digests of stored files or contents.

Files are listed as a Spark job, folder by folder: a level of folders is a table, its tasks list them, and what
is a folder again is the next level. No list of paths comes to the driver. Tasks open files themselves,
with the file systems of pyarrow (local, HDFS, S3, GCS), and read them in blocks: memory does not grow with a file.
"""

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfold.session import scratch_path

BLOCK_BYTES = 8 * 1024 * 1024
# Rows of a listing handed on at a time.
LISTED_ROWS = 10_000
# A task hashes files of about so many bytes; a larger file is a task's only one.
TASK_BYTES = 256 * 1024 * 1024
# What opening a file costs, in bytes.
OPEN_BYTES = 1024 * 1024

ENTRIES = "path string, size long, is_folder boolean"


def content_manifest(contents: DataFrame, path: str, content: Column) -> DataFrame:
    """``path, size, commit_id`` (sha256) and ``etag`` (md5) of each content."""
    data = content.cast("binary")
    return contents.select(
        F.col(path).alias("path"),
        F.octet_length(data).cast("long").alias("size"),
        F.sha2(data, 256).alias("commit_id"),
        F.md5(data).alias("etag"),
    )


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The files and folders in each folder, paths as URIs."""
    from pyarrow import fs

    for batch in batches:
        for uri in batch["path"]:
            files, name = fs.FileSystem.from_uri(uri)
            found = files.get_file_info(fs.FileSelector(name))
            for start in range(0, len(found), LISTED_ROWS):
                part = found[start : start + LISTED_ROWS]
                yield pd.DataFrame(
                    {
                        "path": [f"{uri.rstrip('/')}/{quote(info.base_name, safe="=,@~")}" for info in part],
                        "size": [info.size or 0 for info in part],
                        "is_folder": [info.type == fs.FileType.Directory for info in part],
                    }
                )


def _hash_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path in batch["path"]:
            files, name = fs.FileSystem.from_uri(path)
            sha, md5, size = hashlib.sha256(), hashlib.md5(), 0
            with files.open_input_stream(name) as stream:
                while block := stream.read(BLOCK_BYTES):
                    sha.update(block)
                    md5.update(block)
                    size += len(block)
            digests.append((size, sha.hexdigest(), md5.hexdigest()))
        sizes, commits, etags = zip(*digests) if digests else ((), (), ())
        yield pd.DataFrame({"path": batch["path"], "size": sizes, "commit_id": commits, "etag": etags})


def qualified(spark: SparkSession, root: str) -> str:
    """The URI of a path, with the scheme of the file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    text = uri.getScheme() + "://" + (uri.getRawAuthority() or "") + uri.getRawPath()
    return text.rstrip("/") or text


def list_files(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """``path, size`` of every file below ``root``, files without content and hidden ones included.

    One job per level of folders. A level of many folders is spread over ``tasks`` (by default the session's
    shuffle partitions); one folder is listed in one task. A ``root`` that is missing fails, an empty one gives no rows.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    target, depth = scratch_path(spark, "listing"), 0
    level = spark.createDataFrame([(qualified(spark, root),)], "path string")
    while True:
        # Neighbouring folders are often alike in size, so they are dealt by hash.
        level.repartition(tasks, "path").mapInPandas(_list_folders, ENTRIES).write.parquet(f"{target}/depth={depth}")
        level = spark.read.schema(ENTRIES).parquet(f"{target}/depth={depth}").where("is_folder").select("path")
        if level.isEmpty():
            break
        depth += 1
    return spark.read.schema(ENTRIES).parquet(target).where("not is_folder").select("path", "size")


def file_manifest(spark: SparkSession, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``path`` (a URI), ``size, commit_id`` and ``etag`` of all files below ``root``.

    Files are dealt to tasks by size: one of ``task_bytes`` or more has a task's share to itself, smaller ones
    meet by hash in as many shares as their bytes ask for. ``size`` is that of the bytes that were hashed.
    """
    files = list_files(spark, root)
    cost = F.least(F.col("size"), F.lit(task_bytes)) + F.least(F.lit(OPEN_BYTES), F.lit(task_bytes))
    total = files.agg(F.sum(cost)).first()[0] or 0
    shares = max(1, min(-(-total // task_bytes), 1_000_000))
    dealt = files.select("path").repartition(shares, "path")
    return dealt.mapInPandas(_hash_blocks, "path string, size long, commit_id string, etag string")
