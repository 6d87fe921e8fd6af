"""Incremental synchronisation: what changed between two states of a corpus, and the tables after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopegrain.shared import materialise


def indexed_hashes(chunks: DataFrame) -> DataFrame:
    """(path, hash): the hash that the chunk with the smallest id of each file carries; from (id, path, hash)."""
    return chunks.groupBy("path").agg(F.min_by("hash", "id").alias("hash"))


def changes(current: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """(path, status) of two states (path, hash): added, updated, removed or same; with ``force`` all that stayed is updated.

    One full outer join. Null paths drop out; repeated rows count once; of several hashes of a path the smallest counts; a null
    hash differs from any other.
    """
    sides = [d.filter("path is not null").groupBy("path").agg(F.min("hash").alias("hash"), F.lit(True).alias("there")) for d in (current, indexed)]
    a, b = sides[0].withColumnsRenamed({"hash": "new", "there": "now"}), sides[1].withColumnsRenamed({"hash": "old", "there": "before"})
    differs = F.lit(force) | ~F.col("new").eqNullSafe(F.col("old"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(differs, "updated").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def numbered(fresh: DataFrame, order: list[str], above: int, name: str = "id") -> DataFrame:
    """``fresh`` with ``id``: above + 1 and on, in the given order (nulls first), without pulling all rows into one task.

    Rows are range-partitioned by the order and written once, each with its partition's number; the sizes are counted and the
    rows numbered from that table, so that both see one placement, whatever the range sampler or adaptive execution would do
    in another job. Only the partitions' sizes go to the driver. Rows that are equal in the order are told apart by their
    other columns; rows equal throughout are interchangeable. An empty table gives no rows.
    """
    spark = fresh.sparkSession
    order = [*order, "_tie"]
    tied = fresh.withColumn("_tie", F.xxhash64(*fresh.columns))
    placed = materialise(tied.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "placed")
    sizes = sorted((r["_part"], r.n) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, run = [], above
    for part, n in sizes:
        before.append((part, run))
        run += n
    # One row for each partition.
    start = F.broadcast(spark.createDataFrame(before, "_part int, _start bigint"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = placed.withColumn("_local", local).join(start, "_part")
    return ranked.select(*fresh.columns, (F.col("_local") + F.col("_start")).alias(name))


def apply_changes(chunks: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """The chunk table after a sync: without chunks of updated and removed files, with those of added and updated ones.

    ``chunks`` and ``fresh`` have the same columns, but that ``fresh`` has no id; new ids follow the largest id held.
    """
    gone = diff.filter(F.col("status").isin("updated", "removed")).select("path")
    come = diff.filter(F.col("status").isin("added", "updated")).select("path")
    top = chunks.agg(F.max("id").alias("m")).first().m or 0
    new = numbered(fresh.join(come, "path", "left_semi"), ["path", "start_line", "chunk_index"], top)
    return chunks.join(gone, "path", "left_anti").unionByName(new.select(*chunks.columns))


def change_counts(diff: DataFrame) -> DataFrame:
    """(added, updated, removed), one row."""
    return diff.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "removed")))
