"""The tag graph: term statistics, tag choice and assignment, co-occurrence edges, expansion and inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopegrain.functions.text import terms
from scopegrain.shared import materialise

#: Texts in the longest uncut inverted list.
BLOCK = 4_096


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): how often each term stands in each text; null texts have none, repeated rows count once."""
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    return own.select("id", F.explode(terms("text")).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term): the distinct terms of each text; texts are read where they lie and never shuffled."""
    own = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(terms(text_col))).alias("term"))
    return own.distinct()


def document_counts(counts: DataFrame) -> DataFrame:
    """(term, df)."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def choose_tags(df: DataFrame, id_col: str, text_col: str, most: int = 50) -> DataFrame:
    """(term, score): the ``most`` terms with the largest sum of tf * ln(1 + N / df); equal scores by name.

    One pass to (term, tf, df) with map-side sums; N is a one-row side.
    """
    counts = term_counts(df, id_col, text_col).groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    size = df.agg(F.count_distinct(F.col(id_col)).alias("n"))
    scored = counts.join(F.broadcast(size)).select("term", F.round(F.col("tf") * F.log(1 + F.col("n") / F.col("df")), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "term").limit(most)


def assign_tags(df: DataFrame, id_col: str, text_col: str, tags: DataFrame) -> DataFrame:
    """(id, tag_id): the tags (id, name) whose name is a term of the text."""
    own = term_sets(df, id_col, text_col)
    named = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("term")).distinct()
    return own.join(named, "term").select("id", "tag_id").distinct()


def edges_of(assigned: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: in how many texts two tags stand together; from (id, tag_id).

    A text's tags meet in its own sorted list, so the list is shuffled once and no text is joined with itself.
    """
    lists = assigned.groupBy("id").agg(F.array_sort(F.collect_set("tag_id")).alias("t"))
    one = lists.select("t", F.posexplode("t").alias("i", "a"))
    pairs = one.select("a", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def both_ways(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, weight) from undirected edges, each in both directions; nulls and loops drop out."""
    own = edges.filter("a is not null and b is not null and weight is not null and a <> b")
    return own.select(*keys, F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "weight").select(*keys, "e.a", "e.b", "weight")


def expand_tags(edges: DataFrame, seeds: DataFrame, keys: list[str], most: int = 10, least: float = 0.1) -> DataFrame:
    """(keys, tag, weight, source): the tags one step from the seeds (keys, tag), by their strongest edge, without the seeds.

    Edges below ``least`` do not count. The ``most`` strongest of each key; equal ones by tag; the smallest source wins.
    """
    near = both_ways(edges.filter(F.col("weight") >= least), keys)
    own = seeds.select(*keys, F.col("tag").alias("a")).distinct()
    reached = near.join(own, [*keys, "a"]).join(own.withColumnRenamed("a", "b"), [*keys, "b"], "left_anti")
    best = reached.groupBy(*keys, F.col("b").alias("tag")).agg(F.max("weight").alias("weight"), F.min_by("a", F.struct(-F.col("weight"), F.col("a"))).alias("source"))
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("weight"), "tag")
    return best.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")


def connections(edges: DataFrame, keys: list[str], most: int = 100, least: float = 0.01) -> DataFrame:
    """(keys, tag, connections): how many tags lie one step from each tag, counted up to ``most``."""
    near = both_ways(edges.filter(F.col("weight") >= least), keys).select(*keys, F.col("a").alias("tag"), "b").distinct()
    return near.groupBy(*keys, "tag").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("connections"))


def list_tags(tags: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """(name, weight, connections) of the ``most`` heaviest tags, over (id, name, weight) and edges (a, b, weight)."""
    first = tags.select("id", "name", "weight").distinct().orderBy(F.desc_nulls_last("weight"), "name").limit(most)
    own = connections(edges, []).withColumnRenamed("tag", "id")
    return first.join(own, "id", "left").select("name", "weight", F.coalesce("connections", F.lit(0).cast("bigint")).alias("connections"))


def inspect_tag(tags: DataFrame, edges: DataFrame, name: str, most: int = 20, least: float = 0.01) -> DataFrame:
    """(name, weight): what occurs together with one tag; no rows for an unknown tag."""
    seed = tags.filter(F.col("name") == name).select(F.col("id").alias("tag")).distinct()
    found = expand_tags(edges, seed, [], most, least)
    return found.join(tags.select(F.col("id").alias("tag"), "name").distinct(), "tag").select("name", "weight")


def similar_terms(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, similarity): all pairs of texts (id, text) whose sets of terms have a Jaccard similarity over ``least``.

    Terms stand in one order, those rare on the right side first. Two sets that reach ``least`` share a term among the first
    n - ceil(least * n) + 1 of each, and enough terms follow the first one they share. Lists are cut into blocks of ``BLOCK``.
    """
    a, b = (materialise(term_sets(side, "id", "text"), "terms") for side in (left, right))
    often = document_counts(b)

    def ordered(sets: DataFrame) -> DataFrame:
        own = sets.join(often, "term", "left").select("id", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term").alias("t"))
        return own.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("terms"))

    def posted(sets: DataFrame, side: str) -> DataFrame:
        n = F.size("terms")
        first = F.slice("terms", 1, n - F.ceil(n * least - 1e-9).cast("int") + 1)
        own = sets.select(F.col("id").alias(f"{side}_id"), n.alias(f"{side}_n"), F.posexplode(first).alias(f"{side}_at", "t"))
        return own.select(f"{side}_id", f"{side}_n", f"{side}_at", F.col("t.term").alias("term"), F.ceil(F.col("t.df") / BLOCK).alias("blocks"))

    x, y = ordered(a), ordered(b)
    lists = posted(y, "right").withColumn("block", F.pmod(F.xxhash64("right_id"), "blocks")).drop("blocks")
    asked = posted(x, "left").filter("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    follow = F.least(F.col("left_n") - F.col("left_at"), F.col("right_n") - F.col("right_at"))
    pairs = asked.join(lists, ["term", "block"]).filter(follow >= (F.col("left_n") + F.col("right_n")) * (least / (1 + least)) - 1e-9).select("left_id", "right_id").distinct()
    both = pairs.join(x.select(F.col("id").alias("left_id"), F.col("terms.term").alias("x")), "left_id").join(y.select(F.col("id").alias("right_id"), F.col("terms.term").alias("y")), "right_id")
    value = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return both.select("left_id", "right_id", F.round(value, 6).alias("similarity")).filter(F.col("similarity") > least)
