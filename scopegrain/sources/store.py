"""The stored index: tables of one root as Parquet behind one pointer, its settings as JSON, and the registry of roots."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopegrain.shared import file_at

_V = T.ArrayType(T.FloatType())
_D = T.ArrayType(T.DoubleType())
#: The tables of an index and their columns.
SCHEMAS = {
    name: T.StructType([T.StructField(c, k) for c, k in columns])
    for name, columns in {
        "model_meta": [("id", T.LongType()), ("model_id", T.StringType()), ("dimensions", T.IntegerType()), ("fingerprint", T.StringType()), ("is_active", T.IntegerType()), ("created_at", T.TimestampType())],
        "files": [("id", T.LongType()), ("path", T.StringType()), ("hash", T.StringType()), ("size", T.LongType()), ("mtime", T.LongType()), ("indexed_at", T.TimestampType())],
        "chunks": [("id", T.LongType()), ("path", T.StringType()), ("hash", T.StringType()), ("chunk_index", T.IntegerType()), ("start_line", T.IntegerType()), ("end_line", T.IntegerType()), ("content", T.StringType()), ("heading", T.StringType()), ("stale", T.IntegerType())],
        "vectors": [("id", T.LongType()), ("vector", _V)],
        "axes": [("axes", T.ArrayType(_D)), ("strengths", _D), ("k", T.IntegerType())],
        "tags": [("id", T.LongType()), ("name", T.StringType()), ("weight", T.DoubleType()), ("vector", _V), ("stale", T.IntegerType())],
        "file_tags": [("file_id", T.LongType()), ("tag_id", T.LongType())],
        "edges": [("a", T.LongType()), ("b", T.LongType()), ("weight", T.DoubleType())],
        "roots": [("id", T.LongType()), ("path", T.StringType()), ("store", T.StringType()), ("parent_id", T.LongType())],
    }.items()
}


class Store:
    """Tables below one folder. Writes go to new folders; then one pointer file, which names the folders of all tables, is
    replaced by a rename that overwrites. A reader sees all tables before a write or all after it, whenever it comes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _text(self, name: str) -> str | None:
        path, fs = file_at(self.spark, f"{self.folder}/{name}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _replace(self, name: str, text: str) -> None:
        """Write a small file at once: readers find the old one or the new one."""
        fresh, fs = file_at(self.spark, f"{self.folder}/{name}-{uuid.uuid4().hex}.next")
        stream = fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target, _ = file_at(self.spark, f"{self.folder}/{name}")
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs
        overwrite = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, target, overwrite)

    def version(self) -> dict[str, str]:
        """The folder of each table, as the pointer has them now."""
        return json.loads(self._text("current.json") or "{}")

    def has(self, table: str) -> bool:
        """Whether the table was written and its folder is still there."""
        at = self.version().get(table)
        if at is None:
            return False
        path, fs = file_at(self.spark, f"{self.folder}/{at}")
        return fs.exists(path)

    def read(self, table: str, version: dict[str, str] | None = None) -> DataFrame:
        """The table as last written, or of a ``version``; empty if it never was."""
        at = (self.version() if version is None else version).get(table)
        schema = SCHEMAS[table]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], schema)

    def write(self, **tables: DataFrame) -> None:
        """Replace these tables, all at once. Those before stay readable for plans that still hold them until the next write."""
        before, fresh = self.version(), {}
        for table, df in tables.items():
            schema = SCHEMAS[table]
            name = fresh[table] = f"{table}-{uuid.uuid4().hex}"
            present = set(df.columns)
            columns = [(df[f.name] if f.name in present else F.lit(0 if f.name == "stale" else None)).cast(f.dataType).alias(f.name) for f in schema]
            df.select(*columns).write.parquet(f"{self.folder}/{name}")
        now = {**before, **fresh}
        self._replace("current.json", json.dumps(now))
        held = {*now.values(), *before.values()}
        place, fs = file_at(self.spark, self.folder)
        for status in fs.listStatus(place):
            found = status.getPath().getName()
            if status.isDirectory() and found.rsplit("-", 1)[0] in fresh and found not in held:
                fs.delete(status.getPath(), True)

    def exists(self) -> bool:
        return "chunks" in self.version()

    def bytes(self) -> int:
        path, fs = file_at(self.spark, self.folder)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def settings(self, defaults: dict[str, Any]) -> dict[str, Any]:
        """The stored settings over the defaults."""
        return {**defaults, **parse_settings(self._text("settings.json") or "{}")}

    def save_settings(self, settings: dict[str, Any]) -> None:
        self._replace("settings.json", json.dumps(settings, indent=2))


def registered(roots: DataFrame, path: str, store: str) -> DataFrame:
    """``roots`` (id, path, store, parent_id) with one more, or with its store changed; every root below the deepest one above it.

    Parents follow from the paths of all roots: the prefixes of each path are joined by equality.
    """
    known = roots.filter(F.col("path") != path)
    own = roots.filter(F.col("path") == path).first()
    top = roots.agg(F.max("id")).first()[0] or 0
    fresh = roots.sparkSession.createDataFrame([(own.id if own else top + 1, path, store)], "id bigint, path string, store string")
    both = known.drop("parent_id").unionByName(fresh)
    parts = F.split("path", "/")
    above = both.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("path")))).alias("x"))
    near = above.select("id", "x.depth", "x.path").join(both.select(F.col("id").alias("above_id"), "path"), "path").filter("id <> above_id")
    return both.join(near.groupBy("id").agg(F.max_by("above_id", "depth").alias("parent_id")), "id", "left").select("id", "path", "store", "parent_id")


def parse_settings(text: str) -> dict[str, Any]:
    """Settings from JSON, comments allowed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL))


def load_settings(path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """Settings from a JSON file, comments allowed, over the defaults; the defaults alone if there is no file."""
    file = Path(path)
    if not file.exists():
        return dict(defaults)
    return {**defaults, **parse_settings(file.read_text(encoding="utf-8"))}


def load_environment(start: str, levels: int = 5) -> dict[str, str]:
    """Names and values of the nearest ``.env`` at or above a folder, up to ``levels`` up; nothing is set by it."""
    folder = Path(start).resolve()
    for place in [folder, *folder.parents][: levels + 1]:
        file = place / ".env"
        if file.is_file():
            pairs = (x.split("=", 1) for x in file.read_text(encoding="utf-8").splitlines() if "=" in x and not x.lstrip().startswith("#"))
            return {k.strip(): v.strip().strip("\"'") for k, v in pairs}
    return {}
