"""Search: exact nearest neighbours, the query stages sensing, boost and retrieve, and lexical de-duplication.

Queries are a stated set; they go to the vectors in blocks of at most ``BLOCK`` rows, so a block's broadcast has a fixed size
and the vectors are never shuffled: every task keeps the best of its rows, and only those meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopegrain.functions import vector as V
from scopegrain.functions.text import round3, terms
from scopegrain.operators.sync import numbered
from scopegrain.shared import materialise

#: Queries that one pass over the vectors scores.
BLOCK = 1_024


@dataclass(frozen=True)
class SearchParams:
    """Tunables of the search stages."""

    top_k: int = 10
    min_similarity: float = 0.25
    max_boost_tags: int = 15
    beta_range: tuple[float, float] = (0.1, 0.5)
    use_residual: bool = True
    tag_floor: float = 0.1
    expansion: int = 10
    drift_gate: float = 0.05
    dedup_threshold: float = 0.90
    sample: int = 30
    components: int = 10
    least_vectors: int = 10
    explore_over: float = 0.6


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, score): the ``k`` vectors with the largest cosine to one query, at least 0; equal scores by id.

    Null, non-finite and zero vectors and those of another width score nothing and drop out; repeated rows count once. The rank
    limit works before the exchange (as a window group limit), so every task sends its ``k`` first ranks only.
    """
    own = vectors.filter(V.usable(vector_col, len(query))).select(F.col(id_col).alias("id"), V.score(vector_col, F.array(*map(F.lit, query))).alias("score"))
    ranked = own.withColumn("r", F.dense_rank().over(Window.orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k)
    return ranked.select("id", "score").distinct()


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, within: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, vector) its ``k`` best vectors (id, vector) by cosine, at least 0.

    Equal scores by id; scores rounded to 6 decimals decide. Unusable vectors neither ask nor answer; repeated rows count once.
    With ``within`` (query_id, group), vectors have a ``group`` too: a query sees the vectors of its groups only, and has its
    ``k`` best in each of them; the result then has the column ``group``.
    """
    spark = vectors.sparkSession
    grouped = within is not None
    asked = queries.filter(V.usable("vector")).select("query_id", V.doubles("vector").alias("vector")).distinct()
    own = vectors.select("id", V.doubles("vector").alias("vector"), *(["group"] if grouped else [])).filter("vector is not null")
    kind = ", ".join(f"{c} {t}" for c, t in [("query_id", "bigint"), *([("group", "bigint")] if grouped else []), ("id", "bigint"), ("score", "double")])
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for block in range(blocks):
        here = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block
        by_width: dict[int, list] = {}
        for row in asked.filter(here).orderBy("query_id").collect():
            by_width.setdefault(len(row.vector), []).append(row)
        allowed: dict[int, list] = {}
        for row in within.filter(here).distinct().collect() if grouped else []:
            allowed.setdefault(row.query_id, []).append(row.group)
        sides = {w: (np.array([r.query_id for r in rows]), _unit(np.array([r.vector for r in rows]))) for w, rows in by_width.items()}
        sent = spark.sparkContext.broadcast((sides, {q: np.unique(g) for q, g in allowed.items()}))
        found = own.mapInArrow(_best_of_batches(sent, k, least, grouped), kind)
        out = found if out is None else out.unionByName(found)
    places = Window.partitionBy("query_id", *(["group"] if grouped else [])).orderBy(F.desc("score"), "id")
    return out.distinct().withColumn("rank", F.row_number().over(places)).filter(F.col("rank") <= k)


def _best_of_batches(sent, k: int, least: float | None, grouped: bool):  # noqa: ANN001, ANN202
    """Each query's ``k`` best of every batch, by group if there are groups; ties by id, so no more than ``k`` leave a batch."""
    names = ["query_id", *(["group"] if grouped else []), "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, allowed = sent.value
        for batch in batches:
            column = batch.column(1)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            groups = batch.column(2).to_numpy(zero_copy_only=False) if grouped else np.zeros(len(ids), np.int64)
            for width, (asking, unit) in sides.items():
                at = np.flatnonzero(np.diff(offsets) == width)
                rows = values[offsets[at][:, None] + np.arange(width)]
                fine = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
                at, rows = at[fine], rows[fine]
                # A repeated row must not take two of a batch's k places.
                keys = np.stack([ids[at].astype(np.int64), groups[at].astype(np.int64)], axis=1)
                once = np.unique(np.concatenate([rows.view(np.int64), keys], axis=1), axis=0, return_index=True)[1]
                at, rows = at[once], rows[once]
                if not len(at):
                    continue
                score = np.round(np.maximum(0.0, unit @ _unit(rows).T), 6)
                for q, name in enumerate(asking):
                    good = np.arange(len(at)) if least is None else np.flatnonzero(score[q] >= least)
                    if grouped:
                        good = good[np.isin(groups[at[good]], allowed.get(int(name), np.empty(0, np.int64)))]
                    elif len(good) > k:
                        # What lies under the k-th score goes before the rest is sorted.
                        good = good[score[q, good] >= np.partition(score[q, good], -k)[-k]]
                    order = good[np.lexsort((ids[at[good]], -score[q, good], groups[at[good]]))]
                    own = groups[at[order]]
                    order = order[np.arange(len(order)) - np.searchsorted(own, own, side="left") < k]
                    parts = [pa.array(np.repeat(name, len(order))), *([pa.array(groups[at[order]].astype(np.int64))] if grouped else []), pa.array(ids[at[order]]), pa.array(score[q, order])]
                    yield pa.RecordBatch.from_arrays(parts, names)

    return run


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def basic_search(vectors: DataFrame, chunks: DataFrame, queries: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """Twice top_k candidates of each query, joined with the chunks that exist, those over the least similarity, top_k of them."""
    hits = nearest_batch(vectors, queries, params.top_k * 2).filter(F.col("score") >= params.min_similarity)
    joined = hits.drop("rank").join(chunks, "id").dropDuplicates(["query_id", "id"])
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= params.top_k).withColumn("similarity", round3("score"))


def scoped_search(vectors: DataFrame, chunks: DataFrame, queries: DataFrame, members: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, id, path, start_line, similarity, rank): hits over several roots.

    ``queries`` have (query_id, root_id, vector), ``members`` (id, member_id) name the roots that a search from a root covers,
    ``vectors`` have (id, vector, group) with their root as group, ``chunks`` (id, path, start_line). Every root covered gives
    its top_k hits over the least similarity; of hits at one place (path and line) the best counts, and top_k of all remain.
    A query or vector without a root is in no scope.
    """
    from scopegrain.operators.scopes import merged_hits

    within = queries.join(members.withColumnRenamed("id", "root_id"), "root_id").select("query_id", F.col("member_id").alias("group"))
    hits = nearest_batch(vectors, queries.select("query_id", "vector"), params.top_k, params.min_similarity, within).drop("rank", "group")
    placed = hits.join(chunks.select("id", "path", "start_line").dropDuplicates(["id"]), "id").withColumn("similarity", round3("score"))
    return merged_hits(placed.select("query_id", "id", "path", "start_line", "similarity"), params.top_k)


def systematic_sample(vectors: DataFrame, n: int = 30) -> DataFrame:
    """Every step-th vector by id, the first ``n`` of them, where step is N // n and at least 1; ids that repeat count once.

    Only ids are placed and ranked (see ``sync.numbered``); the few chosen ones then fetch their rows.
    """
    ids = materialise(vectors.select("id").filter("id is not null").distinct(), "ids")
    step = max(1, ids.count() // n)
    at = numbered(ids, ["id"], -1, "at")
    wanted = at.filter((F.col("at") % step == 0) & (F.col("at") < n * step)).select("id")
    # At most n ids.
    return vectors.join(F.broadcast(wanted), "id", "left_semi").dropDuplicates(["id"])


def main_axes(vectors: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(axes, strengths, k), one written row: the main axes of the systematic sample; none with fewer than ``least_vectors`` vectors.

    Built with the index and stored beside it, so that a search reads one row instead of ranking ids.
    """
    fine = vectors.filter(V.usable("vector")).select("id", "vector")
    if fine.select("id").distinct().limit(params.least_vectors).count() < params.least_vectors:
        return vectors.sparkSession.createDataFrame([], "axes array<array<double>>, strengths array<double>, k int")
    sample = systematic_sample(fine, params.sample).select(F.lit(1).alias("grp"), V.doubles("vector").alias("vector"))
    return materialise(sample.groupBy("grp").applyInPandas(V.principal_axes(params.components), "grp int, axes array<array<double>>, strengths array<double>, k int").drop("grp"), "axes")


def sensing(axes: DataFrame, queries: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """``queries`` (query_id, vector) with ``logic_depth`` and ``mode``: how widely a query spreads over the main axes.

    ``axes`` is the one row of ``main_axes``; without a row the depth is 0.5. The sample's mean is not taken off the query.
    """
    joined = queries.join(F.broadcast(axes.select("axes", "k")), F.lit(True), "left")
    zero = F.transform(V.doubles("vector"), lambda x: x * 0)
    profiled = joined.withColumn("profile", V.energy_profile("vector", F.col("axes"), zero))
    out = profiled.withColumn("logic_depth", F.coalesce(V.logic_depth(F.col("profile.entropy"), F.col("k")), F.lit(0.5)))
    mode = F.when(F.col("logic_depth") > params.explore_over, "explore").otherwise("precise")
    return out.withColumn("mode", mode).select(*queries.columns, "logic_depth", "mode")


def boost(queries: DataFrame, tags: DataFrame, edges: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """``queries`` (query_id, vector, logic_depth) with ``matched``, ``beta``, ``boosted`` and ``drift``.

    The best tags (id, name, vector) over the floor pull the query; tags one edge (a, b, weight) further take part in the
    projection only. A query without a match stays as it is, with beta 0.
    """
    from scopegrain.operators.tags import both_ways, expand_tags

    known = tags.filter(V.usable("vector")).dropDuplicates(["id"])
    top = nearest_batch(known, queries, params.max_boost_tags).filter(F.col("score") > params.tag_floor)
    seeds = top.select("query_id", F.col("id").alias("tag"))
    # Edges reach the queries that hold one of their ends; the queries are a stated set.
    near = seeds.join(both_ways(edges, []), F.col("tag") == F.col("a")).select("query_id", "a", "b", "weight")
    further = expand_tags(near, seeds, ["query_id"], params.expansion, params.tag_floor)
    size = known.agg(F.count(F.lit(1)).alias("tags"))
    named = known.select("id", "name", V.doubles("vector").alias("tag_vector"))
    matched = top.join(named, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("name"), F.col("tag_vector").alias("vector"), F.col("score").alias("similarity")))).alias("m"))
    expanded = further.withColumnRenamed("tag", "id").join(named, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "id", F.col("tag_vector").alias("vector")))).alias("e"))
    joined = queries.join(matched, "query_id", "left").join(expanded, "query_id", "left").join(F.broadcast(size))
    out = joined.withColumn("beta", V.beta(F.col("logic_depth"), F.when(F.col("m").isNull(), 0).otherwise(F.size("m")), F.col("tags"), *params.beta_range))
    likeness = F.transform("m", lambda t: t["similarity"])
    out = out.withColumn("boosted", V.boosting(params.use_residual)(V.doubles("vector"), F.transform("m", lambda t: t["vector"]), likeness, F.transform("e", lambda t: t["vector"]), F.col("beta")))
    return out.withColumn("matched", F.transform("m", lambda t: t["name"])).withColumn("drift", V.drift("boosted", "vector")).drop("m", "e", "tags")


def retrieve(vectors: DataFrame, boosted: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, id, score, similarity, is_secondary, rank): hits of the boosted query and, past the drift gate, of the original.

    Hits of the original count only where the boosted query did not find them. Ranked by the rounded similarity, first the
    boosted query's hits, then by score and id.
    """
    first = nearest_batch(vectors, boosted.select("query_id", F.col("boosted").alias("vector")), params.top_k * 3).filter(F.col("score") >= params.min_similarity)
    second = nearest_batch(vectors, boosted.filter(F.col("drift") > params.drift_gate).select("query_id", "vector"), params.top_k).filter(F.col("score") >= params.min_similarity)
    new = second.join(first, ["query_id", "id"], "left_anti")
    both = first.drop("rank").withColumn("is_secondary", F.lit(False)).unionByName(new.drop("rank").withColumn("is_secondary", F.lit(True)))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "is_secondary", F.desc("score"), "id")
    return both.withColumn("similarity", round3("score")).withColumn("rank", F.row_number().over(order))


def semantic_dedup(hits: DataFrame, threshold: float = 0.90, top_k: int | None = None) -> DataFrame:
    """Hits (query_id, rank, words) without those whose set of words is too like that of a better kept hit.

    Greedy in rank order: a hit goes if its Jaccard similarity with any kept one is over ``threshold``; an empty set is like
    nothing. A query's hits are a few times top_k, so they fit one row.
    """
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "words"))).alias("h"))

    def like(a: Column, b: Column) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))

    empty = F.slice(F.col("h"), 1, 0)
    kept = F.aggregate("h", empty, lambda acc, h: F.when(F.exists(acc, lambda k: like(k["words"], h["words"]) > threshold), acc).otherwise(F.concat(acc, F.array(h))))
    ranks = listed.select("query_id", F.posexplode(F.transform(kept, lambda k: k["rank"])).alias("place", "rank"))
    ranks = ranks if top_k is None else ranks.filter(F.col("place") < top_k)
    return hits.join(ranks.drop("place"), ["query_id", "rank"])


def words_of(text: Column) -> Column:
    """The set of terms that de-duplication compares."""
    return F.array_distinct(terms(text))


def enhanced_search(chunks: DataFrame, tags: DataFrame, edges: DataFrame, queries: DataFrame, params: SearchParams = SearchParams(), axes: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Sensing, boost, retrieve and de-duplication for queries (query_id, vector) over chunks (id, content, vector, ...).

    ``axes`` and ``vectors`` (id, vector) are those stored with the index; without them they are taken from the chunks here.
    """
    vectors = chunks.select("id", "vector") if vectors is None else vectors
    axes = main_axes(vectors, params) if axes is None else axes
    # The queries are a stated set; the steps below use their boosted form several times.
    boosted = materialise(boost(materialise(sensing(axes, queries, params), "sensed"), tags, edges, params), "boosted")
    hits = retrieve(vectors, boosted, params).join(chunks.drop("vector"), "id").dropDuplicates(["query_id", "id"])
    kept = semantic_dedup(hits.withColumn("words", words_of(F.coalesce("content", F.lit("")))), params.dedup_threshold, params.top_k)
    return kept.drop("words").join(boosted.select("query_id", "matched", "logic_depth", "mode"), "query_id")
