"""Items that appear together: a blocked Gram matrix of binary sparse baskets.

The baskets of a group are cut into record blocks and their items into item blocks, each a sparse binary matrix held by its
non-zero places. Each task multiplies the transpose of an item block with the others of its record block, over the records
that hold both, and sends the non-zero counts; these add up over record blocks. Where a pair of blocks is dense, the product
is taken of dense matrices, else of the places alone, so that absent items cost nothing. The diagonal holds the items' own
counts, from which the expected count of every pair follows. A basket of more than ``LARGE`` items is cut into blocks of items
whose pairs go to different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopegrain.shared import materialise

#: Baskets of a record block, items of an item block, and items of the largest uncut basket.
RECORDS, ITEMS, LARGE = 4_096, 1_024, 8_192
#: Pairs of places that one step multiplies, and how many multiplications of a dense product cost as much as one such pair.
STEP, DENSE = 1 << 21, 600


def multiply(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], records: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Non-zero (column of left, column of right, count) of the transpose of ``left`` times ``right``; both are places (record,
    column) sorted by record. A column pair may come in several parts."""
    (row, column), (other, with_) = left, right
    if not len(row) or not len(other):
        return
    start = np.searchsorted(other, np.arange(records + 1))
    times = np.diff(start)[row]
    width, depth = int(column.max()) + 1, int(with_.max()) + 1
    if int(times.sum()) * DENSE > records * width * depth:
        one, two = np.zeros((records, width), np.float32), np.zeros((records, depth), np.float32)
        one[row, column], two[other, with_] = 1, 1
        gram = one.T @ two
        a, b = np.nonzero(gram)
        yield a, b, gram[a, b].astype(np.int64)
        return
    edges = np.searchsorted(np.cumsum(times), np.arange(0, int(times.sum()) + STEP, STEP), side="right")
    for low, high in zip(edges, np.append(edges[1:], len(row)), strict=True):
        part = times[low:high]
        total = int(part.sum())
        if not total:
            continue
        at = np.repeat(start[row[low:high]] - (np.cumsum(part) - part), part) + np.arange(total)
        key, count = np.unique(np.repeat(column[low:high], part) * depth + with_[at], return_counts=True)
        yield key // depth, key % depth, count


def gram_counts(grp: np.ndarray, basket: np.ndarray, item: np.ndarray, records: int = RECORDS, items: int = ITEMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, item a, item b, baskets with both), a <= b, of rows sorted by group and basket; baskets are not split."""
    for begin, end in _stretches(grp, basket, records):
        of = np.cumsum(np.concatenate([[0], basket[begin + 1 : end] != basket[begin : end - 1]]))
        names, column = np.unique(item[begin:end], return_inverse=True)
        block = column // items
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(int(block.max()) + 2))
        blocks = [(of[order[a:b]], column[order[a:b]] % items) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i, left in enumerate(blocks):
            for j in range(i, len(blocks)):
                for a, b, n in multiply(left, blocks[j], int(of[-1]) + 1):
                    a, b, n = (x[a <= b] for x in (a, b, n)) if i == j else (a, b, n)
                    yield np.full(len(a), grp[begin]), names[i * items + a], names[j * items + b], n


def _stretches(grp: np.ndarray, basket: np.ndarray, records: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole baskets of one group, at most ``records`` each."""
    if not len(grp):
        return
    fresh = np.concatenate([[True], (grp[1:] != grp[:-1]) | (basket[1:] != basket[:-1])])
    starts = np.flatnonzero(fresh)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(grp[starts])) + 1, [len(starts)]])
    bounds = np.append(starts, len(grp))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        for at in range(int(low), int(high), records):
            yield int(bounds[at]), int(bounds[min(at + records, int(high))])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of whole baskets, which come sorted."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
        whole = int(last[-1]) + 1 if len(last) and len(columns[0]) >= 200_000 else 0
        held = [c[whole:] for c in columns]
        for part in gram_counts(*(c[:whole] for c in columns)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], NAMES)
    if held is not None:
        for part in gram_counts(*held):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], NAMES)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the cells of large baskets, which come sorted: all pairs of a cell's two item blocks meet once."""
    held: list[np.ndarray] = []

    def pairs(grp: np.ndarray, items: np.ndarray, side: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        one, two = (np.sort(items), np.sort(items)) if same else (items[side == 0], items[side == 1])
        for at in range(0, len(one), 256):
            a, b = np.repeat(one[at : at + 256], len(two)), np.tile(two, len(one[at : at + 256]))
            a, b = (x[a <= b] for x in (a, b)) if same else (np.minimum(a, b), np.maximum(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), grp[0])), pa.array(a), pa.array(b), pa.array(np.ones(len(a), np.int64))], NAMES)

    def closed(c: list[np.ndarray], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            grp, _, item, i, j, side = (x[low:high] for x in c)
            yield from pairs(grp, item, side, bool(i[0] == j[0]))

    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(6)]
        columns = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
        fresh = np.flatnonzero(np.any([np.diff(columns[i]) != 0 for i in (0, 1, 3, 4)], axis=0)) + 1
        yield from closed(columns, np.concatenate([[0], fresh]) if len(fresh) else np.zeros(1, np.int64))
        held = [c[fresh[-1] :] for c in columns] if len(fresh) else columns
    if held and len(held[0]):
        yield from closed(held, np.array([0, len(held[0])]))


NAMES = ["grp", "item_a", "item_b", "n_ab"]


def appear_together(baskets: DataFrame) -> DataFrame:
    """(grp, item_a, item_b, n_ab, n_a, n_b, n, lift), item_a < item_b, from ``baskets`` (grp, basket, item).

    ``n`` counts the group's baskets, ``lift`` is n_ab * n / (n_a * n_b): how much more often than by chance. Rows with a null
    in any of the three columns drop out, repeated rows count once, other columns are ignored; no rows give no rows. A hot
    group or item spreads over as many tasks as its baskets do, a large basket over as many as it has pairs of item blocks.
    """
    own = baskets.select(*(F.col(c).cast("bigint").alias(c) for c in ("grp", "basket", "item"))).na.drop().distinct()
    # The count uses the partitioning by basket, which the products need anyway.
    sized = own.repartition("grp", "basket").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("grp", "basket")))
    schema = "grp bigint, item_a bigint, item_b bigint, n_ab bigint"
    small = sized.filter(F.col("size") <= LARGE).drop("size").sortWithinPartitions("grp", "basket").mapInArrow(_products, schema)
    parts = F.ceil(F.col("size") / (LARGE // 2))
    large = sized.filter(F.col("size") > LARGE).withColumn("mine", F.pmod(F.xxhash64("item"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    large = large.select("grp", "basket", "item", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    large = large.repartition("grp", "basket", "i", "j").sortWithinPartitions("grp", "basket", "i", "j").mapInArrow(_cells, schema)
    counts = materialise(small.unionByName(large).groupBy("grp", "item_a", "item_b").agg(F.sum("n_ab").alias("n_ab")), "counts")
    single = counts.filter("item_a = item_b")
    total = own.select("grp", "basket").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    a = single.select("grp", "item_a", F.col("n_ab").alias("n_a"))
    b = single.select("grp", F.col("item_b"), F.col("n_ab").alias("n_b"))
    joined = counts.filter("item_a < item_b").join(a, ["grp", "item_a"]).join(b, ["grp", "item_b"]).join(total, "grp")
    return joined.select("grp", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"))


def compare_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` with ``stored`` (the edge's weight) and ``verdict``: absent, same or differs.

    The stored weight is the sum over the group's rows (grp, item_a, item_b, weight) of the two items in either order; repeated
    rows count once and a null weight adds 0. Edges with a null item or group, and an item with itself, match no pair.
    """
    own = edges.distinct().select("grp", F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), F.coalesce("weight", F.lit(0.0)).alias("w"), (F.col("item_a").isNull() | F.col("item_b").isNull()).alias("broken"))
    stored = own.filter("not broken").groupBy("grp", "item_a", "item_b").agg(F.sum("w").alias("stored"))
    verdict = F.when(F.col("stored").isNull(), "absent").when(F.col("stored") == F.col("n_ab"), "same").otherwise("differs")
    return pairs.join(stored, ["grp", "item_a", "item_b"], "left").withColumn("verdict", verdict)


def p2_found(spark: SparkSession, sf_dir: str, least: int = 6, times: int = 3) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/files.parquet").select(F.col("id").alias("basket"), F.col("anchor_id").alias("grp")).filter("grp is not null").distinct()
    tags = spark.read.parquet(f"{sf_dir}/tags.parquet").select(F.col("id").alias("item")).distinct()
    carried = spark.read.parquet(f"{sf_dir}/file_tags.parquet").select(F.col("file_id").alias("basket"), F.col("tag_id").alias("item")).distinct()
    pairs = appear_together(carried.join(files, "basket").join(tags, "item", "left_semi"))
    cases = pairs.filter((F.col("n_ab") >= least) & (F.col("n_ab") * F.col("n") >= times * F.col("n_a") * F.col("n_b")))
    edges = spark.read.parquet(f"{sf_dir}/tag_cooccurrence.parquet").withColumnsRenamed({"anchor_id": "grp", "tag_a_id": "item_a", "tag_b_id": "item_b"})
    return compare_edges(cases, edges).select(F.col("grp").alias("anchor_id"), F.col("item_a").alias("tag_a_id"), F.col("item_b").alias("tag_b_id"), "verdict")
