"""Folding of search results: adaptive thresholds, levels of detail, token budgets, sessions and reading on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopegrain.functions import text as T


def thresholds(hits: DataFrame) -> DataFrame:
    """(query_id, full_threshold, summary_threshold) of hits (query_id, similarity, logic_depth).

    Mean and population deviation of the query's scores; a depth over 0.6, or none, widens or keeps the full level. Null scores
    do not count; a query without any gets 0.75 and 0.5. Rounded to 9 decimals, so that no order of summing decides a level.
    """
    own = hits.groupBy("query_id").agg(F.avg("similarity").alias("m"), F.stddev_pop("similarity").alias("s"), F.first("logic_depth", True).alias("d"))
    wide = F.when(F.coalesce("d", F.lit(0.5)) > 0.6, 0.3).otherwise(0.8)
    full = F.when(F.col("m").isNull(), 0.75).otherwise(F.greatest(F.lit(0.30), F.col("m") + F.col("s") * wide))
    summary = F.when(F.col("m").isNull(), 0.50).otherwise(F.greatest(F.lit(0.20), F.col("m") - F.col("s") * 0.3))
    return own.select("query_id", F.round(full, 9).alias("full_threshold"), F.round(summary, 9).alias("summary_threshold"))


def level_of(similarity: Column, full: Column, summary: Column) -> Column:
    return F.when(similarity >= full, 3).when(similarity >= summary, 1).otherwise(0)


def formatted(hits: DataFrame, level: Column) -> DataFrame:
    """Hits with ``level``, ``formatted`` and ``tokens``; from rank, path, start_line, end_line, similarity, content, heading,
    matched and is_secondary."""
    body = F.coalesce("content", F.lit(""))
    head = T.header(F.col("rank"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("similarity"))
    digest = T.structural_digest(body, F.col("heading"), F.col("matched"), F.col("is_secondary"))
    out = hits.withColumn("level", level).withColumn("formatted", T.format_level(F.col("level"), head, digest, T.key_lines(body), body))
    return out.withColumn("tokens", T.estimate_tokens("formatted"))


def fold(hits: DataFrame) -> DataFrame:
    """Each hit at the level its similarity earns within its query."""
    joined = hits.join(thresholds(hits), "query_id")
    return formatted(joined, level_of(F.col("similarity"), F.col("full_threshold"), F.col("summary_threshold"))).drop("full_threshold", "summary_threshold")


def fold_forced(hits: DataFrame, level: int) -> DataFrame:
    return formatted(hits, F.lit(level))


def budget_levels(costs: DataFrame, budget: int) -> DataFrame:
    """(query_id, rank, level): the levels that fit a token budget; from (query_id, rank, similarity, full_threshold, t0, t1, t3).

    If the headers alone exceed the budget, the first ones that fit. Else all start at 0 and, by similarity, are raised to 1
    and then to 3 (those over the full threshold) where the budget allows; what does not fit is passed over. A query's hits
    are a page of results, so they fit one row.
    """
    hit = F.struct((-F.col("similarity")).alias("o"), "rank", "similarity", "full_threshold", *(F.col(c).cast("bigint").alias(c) for c in ("t0", "t1", "t3")))
    listed = costs.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("h"))
    least = F.aggregate("h", F.lit(0).cast("bigint"), lambda a, x: a + x["t0"])
    by_rank = F.array_sort(F.transform("h", lambda x: F.struct(x["rank"].alias("rank"), x["t0"].alias("t0"))))
    first = F.aggregate(
        by_rank,
        F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("full"), F.array().cast("array<struct<rank:int,level:int>>").alias("out")),
        lambda a, x: F.when(a["full"] | (a["used"] + x["t0"] > budget), F.struct(a["used"].alias("used"), F.lit(True).alias("full"), a["out"].alias("out"))).otherwise(
            F.struct((a["used"] + x["t0"]).alias("used"), F.lit(False).alias("full"), F.concat(a["out"], F.array(F.struct(x["rank"].cast("int").alias("rank"), F.lit(0).alias("level")))).alias("out"))
        ),
    )["out"]

    def raised(start: Column, items: Column, to: str, level: int, allowed) -> Column:
        def step(a: Column, x: Column) -> Column:
            more = x[to] - x["cost"]
            fits = (a["used"] + more <= budget) & allowed(x)
            new = F.struct(x["rank"].cast("int").alias("rank"), F.when(fits, F.lit(level)).otherwise(x["level"]).alias("level"), F.when(fits, x[to]).otherwise(x["cost"]).alias("cost"), x["similarity"].alias("similarity"), x["full_threshold"].alias("full_threshold"), x["t1"].alias("t1"), x["t3"].alias("t3"))
            return F.struct(F.when(fits, a["used"] + more).otherwise(a["used"]).alias("used"), F.concat(a["out"], F.array(new)).alias("out"))

        kind = "array<struct<rank:int,level:int,cost:bigint,similarity:double,full_threshold:double,t1:bigint,t3:bigint>>"
        return F.aggregate(items, F.struct(start.alias("used"), F.array().cast(kind).alias("out")), step)

    opened = F.transform("h", lambda x: F.struct(x["rank"].cast("int").alias("rank"), F.lit(0).alias("level"), x["t0"].alias("cost"), x["similarity"].cast("double").alias("similarity"), x["full_threshold"].cast("double").alias("full_threshold"), x["t1"].alias("t1"), x["t3"].alias("t3")))
    once = listed.withColumn("least", least).withColumn("one", raised(F.col("least"), opened, "t1", 1, lambda x: F.lit(True)))
    twice = once.withColumn("two", raised(F.col("one.used"), F.col("one.out"), "t3", 3, lambda x: x["similarity"] >= x["full_threshold"]))
    chosen = F.when(F.col("least") > budget, first).otherwise(F.transform("two.out", lambda x: F.struct(x["rank"].alias("rank"), x["level"].alias("level"))))
    return twice.select("query_id", F.explode(chosen).alias("c")).select("query_id", "c.rank", "c.level")


def fold_budget(hits: DataFrame, budget: int) -> DataFrame:
    """Hits at the levels that fit ``budget`` tokens; those that do not fit at all drop out. A budget of 0 means none."""
    if not budget:
        return fold(hits)
    costs = hits.join(thresholds(hits), "query_id").select("query_id", "rank", "similarity", "full_threshold")
    for level in (0, 1, 3):
        costs = costs.join(fold_forced(hits, level).select("query_id", "rank", F.col("tokens").alias(f"t{level}")), ["query_id", "rank"])
    levels = budget_levels(costs, budget).withColumnRenamed("level", "chosen")
    return formatted(hits.join(levels, ["query_id", "rank"]), F.col("chosen")).drop("chosen")


def summary(folded: DataFrame) -> DataFrame:
    """(query_id, shown, complete, digests, folded, tokens): how many hits stand at levels 3, 1 and 0, and all tokens."""
    return folded.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("shown"), F.count_if(F.col("level") == 3).alias("complete"), F.count_if(F.col("level") == 1).alias("digests"), F.count_if(F.col("level") == 0).alias("folded"), F.sum("tokens").alias("tokens")
    )


def neighbours(chunks: DataFrame, direction: str = "both") -> DataFrame:
    """Chunks (id, file_id, start_line) with ``before_id`` and ``after_id``, by start line and id within the file.

    ``direction`` is before, after or both; the other side is null. Repeated rows count once; null start lines stand first.
    """
    order = Window.partitionBy("file_id").orderBy("start_line", "id")
    own = chunks.select("id", "file_id", "start_line").distinct()
    sides = {"before": F.lag("id").over(order), "after": F.lead("id").over(order)}
    return own.select("id", "file_id", "start_line", *((c if direction in (side, "both") else F.lit(None).cast("bigint")).alias(f"{side}_id") for side, c in sides.items()))


def latest_sessions(sessions: DataFrame, keep: int = 10) -> DataFrame:
    """The ``keep`` latest sessions (client, seq, ...) of each client."""
    return sessions.withColumn("rn", F.row_number().over(Window.partitionBy("client").orderBy(F.desc("seq")))).filter(F.col("rn") <= keep).drop("rn")
