"""Scopes: the tree of indexed roots, nearest ancestors, and the members of a local, bubble, cascade or merge search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopegrain.shared import materialise


def ancestors(roots: DataFrame) -> DataFrame:
    """(id, ancestor_id, distance): every root's ancestors over (id, parent_id); a missing parent ends the chain, as does a
    root that the chain has passed.

    By doubling: with all ancestors up to a distance d known, one join with those at exactly d gives all up to 2 d. So a chain
    of any depth takes the logarithm of its depth in rounds, each cut off in a written table. Repeated rows count once.
    """
    own = roots.select("id", "parent_id").distinct()
    known = own.join(own.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    jump = materialise(known.select("id", F.col("parent_id").alias("ancestor_id")), "jumps")
    near, size = materialise(jump.filter("id <> ancestor_id").withColumn("distance", F.lit(1)), "ancestors"), -1
    reach = 1
    while (count := near.count()) != size:
        size = count
        onward = jump.withColumnsRenamed({"ancestor_id": "via"})
        # A root that comes round to itself is no ancestor, but what lies beyond it is reached through the next jump.
        further = onward.join(near.withColumnRenamed("id", "via"), "via").select("id", "ancestor_id", (F.col("distance") + reach).alias("distance"))
        landed = jump.withColumn("distance", F.lit(reach))
        both = near.unionByName(further).unionByName(landed).filter("id <> ancestor_id")
        near = materialise(both.groupBy("id", "ancestor_id").agg(F.min("distance").alias("distance")), "ancestors")
        jump = materialise(onward.join(jump.withColumnRenamed("id", "via"), "via").select("id", "ancestor_id"), "jumps")
        reach *= 2
    return near


def nearest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(file_id, root_id): the deepest root (id, path) whose path is a prefix of the file's (id, path), by whole components.

    A file's prefixes are exploded and joined by equality, so no pair of file and root is tried in vain.
    """
    plain = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./)+", "")
    parts = files.select(F.col("id").alias("file_id"), F.split(plain, "/").alias("p")).distinct()
    prefixes = parts.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(F.col("p"), 1, i), "/").alias("path")))).alias("x")).select("file_id", "x.depth", "x.path")
    named = roots.select(F.col("id").alias("root_id"), "path").distinct()
    return prefixes.join(named, "path").groupBy("file_id").agg(F.max_by("root_id", "depth").alias("root_id"))


def members(roots: DataFrame, up: DataFrame, scope: str) -> DataFrame:
    """(id, member_id): the roots that a search from each root covers.

    local: itself; bubble: and its parent; cascade: and its children; merge: and all ancestors and its children.
    """
    own = roots.select("id", F.col("id").alias("member_id")).distinct()
    parent = up.filter("distance = 1").select("id", F.col("ancestor_id").alias("member_id"))
    child = parent.select(F.col("member_id").alias("id"), F.col("id").alias("member_id"))
    above = up.select("id", F.col("ancestor_id").alias("member_id"))
    parts = {"local": [own], "bubble": [own, parent], "cascade": [own, child], "merge": [own, above, child]}[scope]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def subtree_totals(roots: DataFrame, up: DataFrame, own: DataFrame, sums: list[str]) -> DataFrame:
    """(id, sums): ``own`` figures by root (id, ...) added up over each root's subtree; a root without figures adds 0."""
    below = up.select(F.col("ancestor_id").alias("id"), F.col("id").alias("member_id")).unionByName(roots.select("id", F.col("id").alias("member_id")).distinct())
    joined = below.join(own.withColumnRenamed("id", "member_id"), "member_id", "left")
    return joined.groupBy("id").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums))


def merged_hits(hits: DataFrame, top_k: int) -> DataFrame:
    """The best hit of each place (query_id, path, start_line, similarity, id), then the ``top_k`` best of each query."""
    best = Window.partitionBy("query_id", "path", "start_line").orderBy(F.desc("similarity"), "id")
    own = hits.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "path", "start_line", "id"))).filter(F.col("rank") <= top_k)


def prefixed(path: str, prefix: str) -> Column:
    """A path below another; an empty or null prefix adds nothing."""
    return F.concat_ws("/", F.when(F.col(prefix) != "", F.col(prefix)), F.col(path))
