"""Reading a directory tree as a corpus: names first, then only the files that are wanted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopegrain.functions.text import content_hash, wanted_path
from scopegrain.shared import materialise

#: What is read and what is passed over unless a root says otherwise.
EXTENSIONS = (".md", ".ts", ".js", ".py", ".txt", ".json", ".yaml", ".yml", ".tsx", ".jsx", ".rs", ".go", ".java", ".c", ".cpp", ".h")
IGNORE = ("node_modules", ".git", "dist", "*.lock")
#: Entries that one task lists before it hands the folders that are left to others.
LISTED = 20_000


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root, given as a path or an address, and the root's path there."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), root


def listing(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, mtime) of all files below ``root``, paths relative to it; a written table without any content.

    Ignored folders are not opened, unreadable ones are passed over, and no name is hidden. Folders are spread over the tasks;
    one that finds more than ``LISTED`` entries leaves the rest of its folders to the next round.
    """
    base = root.rstrip("/") or "/"
    skipped, most = frozenset(ignore), LISTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_root(base)
        for batch in batches:
            waiting, found = list(batch.column(0).to_pylist()), []
            while waiting and len(found) < most:
                folder = waiting.pop()
                try:
                    entries = system.get_file_info(fs.FileSelector(f"{top}/{folder}" if folder else top, allow_not_found=True))
                except OSError:
                    continue
                for e in entries:
                    path = f"{folder}/{e.base_name}" if folder else e.base_name
                    if e.base_name in skipped:
                        continue
                    if e.type == fs.FileType.Directory:
                        waiting.append(path)
                    elif e.type == fs.FileType.File:
                        found.append((path, e.size, None if e.mtime_ns is None else e.mtime_ns // 1_000_000))
            rows = [(*f, False) for f in found] + [(w, None, None, True) for w in waiting]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["path", "size", "mtime", "folder"])

    def listed(folders: DataFrame) -> DataFrame:
        return materialise(folders.mapInArrow(run, "path string, size bigint, mtime bigint, folder boolean"), "listing")

    rounds = [listed(spark.createDataFrame([("",)], "path string"))]
    while True:
        open_ = rounds[-1].filter("folder").select("path")
        left = open_.count()
        if not left:
            break
        rounds.append(listed(open_.repartition(min(left, spark.sparkContext.defaultParallelism * 4))))
    out = rounds[0]
    for other in rounds[1:]:
        out = out.unionByName(other)
    return out.filter("not folder").drop("folder")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, ignore: tuple[str, ...] = IGNORE, nested: DataFrame | None = None) -> DataFrame:
    """(path, content, hash, size, mtime) of the wanted files below ``root``, paths relative to it.

    ``ignore`` names whole path components. Files below one of the ``nested`` roots (path, relative) are left to those. Only
    wanted files are opened; unreadable ones are passed over. Bytes that are no UTF-8 become replacement characters.
    """
    own = listing(spark, root, ignore).filter(wanted_path("path", list(extensions), list(ignore)))
    if nested is not None:
        parts = F.split("path", "/")
        above = own.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("above"))
        inside = above.join(nested.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
        own = own.join(inside, "path", "left_anti")
    base = root.rstrip("/") or "/"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_root(base)
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with system.open_input_stream(f"{top}/{path}") as stream:
                        text = stream.read().decode("utf-8", "replace")
                except OSError:
                    continue
                # One file a batch, so that long files do not add up.
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text]), batch.column(1).slice(i, 1), batch.column(2).slice(i, 1)], ["path", "content", "size", "mtime"])

    spread = own.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    texts = spread.mapInArrow(read, "path string, content string, size bigint, mtime bigint")
    return texts.select("path", "content", content_hash("content").alias("hash"), "size", "mtime")
