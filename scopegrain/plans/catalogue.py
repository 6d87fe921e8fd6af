"""Every query of the core operators, with the SQL that must give the same rows.

All queries read whole tables. Searches ask with every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopegrain.functions import text as T
from scopegrain.functions import vector as V
from scopegrain.operators import chunkers, fold, scopes, search, sync, tags
from scopegrain.shared import materialise
from scopegrain.sources import files as file_source
from scopegrain.sources import models

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def usable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").filter(V.usable("vector", 64))


def chunk_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_chunks(spark, sf_dir).filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector").dropDuplicates(["query_id"])


# SQL pieces

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_HAN = "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}]{2,}"


def _terms_sql(source: str, key: str, text: str) -> str:
    """A query of (id, term), one row for each occurrence."""
    return f"""SELECT id, term FROM (
        SELECT id, unnest(regexp_split_to_array(w, '_+')) AS term FROM (
            SELECT id, lower(unnest(regexp_extract_all(t, '{T.LATIN}'))) AS w FROM (SELECT DISTINCT {key} AS id, {text} AS t FROM {source})
        ) WHERE w NOT IN ({_STOP})
    ) WHERE length(term) >= 2 AND term NOT IN ({_STOP})
    UNION ALL
    SELECT id, term FROM (
        SELECT id, unnest(list_concat(list_transform(range(1, length(r)), lambda i: substring(r, i, 2)), CASE WHEN length(r) <= 4 THEN [r] ELSE [] END)) AS term
        FROM (SELECT id, unnest(regexp_extract_all(t, '{_HAN}')) AS r FROM (SELECT DISTINCT {key} AS id, {text} AS t FROM {source}))
    ) WHERE term NOT IN ({_STOP})"""

_WHITE = "[\\s\\x0b\\x{a0}\\x{feff}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_SIGNATURE = "(?:^|[\\n\\r\\x{85}\\x{2028}\\x{2029}])([ \\t]*(?:export[\\s\\x0b]+)?(?:default[\\s\\x0b]+)?(?:async[\\s\\x0b]+)?(?:function|class|interface|type|const|enum)[\\s\\x0b]+\\w+[^{;]*)"


def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


def _tokens_sql(x: str) -> str:
    return f"ceil(len(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}]')) * 1.5 + (length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10ffff}}]')) - len(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}]'))) / 4)::BIGINT"


def _shown_sql(hits: str) -> str:
    """WITH parts that end in ``f``: hits (rank, path, start_line, end_line, similarity, content, heading, ...) with head and digest."""
    han = f"regexp_extract_all(c, '{_HAN}')"
    return f"""a AS (SELECT *, coalesce(content, '') AS c FROM {hits}),
    b AS (SELECT *, nullif({_trim_sql(f"regexp_extract(c, '{_SIGNATURE}', 1)")}, '') AS sig0,
        list_concat(list_filter(flatten(list_transform(list_filter(list_transform(regexp_extract_all(c, '{T.LATIN}'), lambda w: lower(w)), lambda w: w NOT IN ({_STOP})), lambda w: regexp_split_to_array(w, '_+'))), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})),
            list_filter(list_concat(flatten(list_transform({han}, lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))), list_filter({han}, lambda r: length(r) <= 4)), lambda w: w NOT IN ({_STOP}))) AS own FROM a),
    d AS (SELECT *, substring(sig0, 1, 100) AS sig, CASE WHEN sig0 IS NULL THEN nullif(array_to_string(list_transform(list_slice(list_sort(list_transform(list_filter(own, lambda x, i: list_position(own, x) = i), lambda x, i: {{'n': -len(list_filter(own, lambda y: y = x)), 'i': i, 't': x}})), 1, 5), lambda s: s.t), ' · '), '') END AS finger,
        {_trim_sql("list_filter(string_split(c, chr(10)), lambda x: length(" + _trim_sql("x") + ") > 10)[1]")} AS line FROM b),
    f AS (SELECT *, '[' || rank || '] ' || coalesce(path, '?') || ' (L' || coalesce(start_line::VARCHAR, '?') || '-L' || coalesce(end_line::VARCHAR, '?') || ') [' || regexp_replace(regexp_replace(printf('%.3f', similarity), '0+$', ''), '\\.$', '') || ']' AS head,
        coalesce(nullif(concat_ws(chr(10) || '    ', CASE WHEN heading <> '' THEN '📂 ' || heading END, '⚡ ' || sig, '📝 ' || finger), ''), CASE WHEN length(line) > 80 THEN substring(line, 1, 80) || '...' ELSE line END, '') AS digest FROM d)"""


_RULE = "chr(10) || '    ───' || chr(10) || '    '"
_LEVEL_1 = "head || chr(10) || '    ' || digest"
_LEVEL_3 = f"{_LEVEL_1} || {_RULE} || c"


_DOC_TF = f"SELECT id, term, count(*) AS tf FROM ({_terms_sql('documents', 'doc_id', 'text')}) GROUP BY id, term"
_USABLE = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_CHUNKS = f"(SELECT DISTINCT ON (id) id, file_id, vector::DOUBLE[] AS v FROM chunks WHERE {_USABLE})"
_TAGS = f"(SELECT DISTINCT ON (id) id, name, vector::DOUBLE[] AS v FROM tags WHERE {_USABLE})"
_EDGES = "SELECT DISTINCT anchor_id, tag_a_id AS a, tag_b_id AS b, weight FROM tag_cooccurrence WHERE weight IS NOT NULL AND tag_a_id IS NOT NULL AND tag_b_id IS NOT NULL AND tag_a_id <> tag_b_id"
_BOTH = f"SELECT anchor_id, a, b, weight FROM ({_EDGES}) UNION ALL SELECT anchor_id, b, a, weight FROM ({_EDGES})"
_ROOTS = "SELECT DISTINCT id, path, coalesce(parent_id, nullif(id // 2, 0)) AS parent_id FROM anchors"
_UP = f"""WITH RECURSIVE r AS ({_ROOTS}), up(id, ancestor_id, distance) AS (
    SELECT c.id, p.id, 1 FROM r c JOIN r p ON c.parent_id = p.id
    UNION ALL SELECT u.id, p.id, u.distance + 1 FROM up u JOIN r c ON u.ancestor_id = c.id JOIN r p ON c.parent_id = p.id)"""
_MEMBERS = f"""{_UP}, m AS (SELECT 'local' AS scope, id, id AS member_id FROM r UNION SELECT 'bubble', id, id FROM r UNION SELECT 'cascade', id, id FROM r UNION SELECT 'merge', id, id FROM r
    UNION SELECT 'bubble', id, ancestor_id FROM up WHERE distance = 1 UNION SELECT 'cascade', ancestor_id, id FROM up WHERE distance = 1
    UNION SELECT 'merge', id, ancestor_id FROM up UNION SELECT 'merge', ancestor_id, id FROM up WHERE distance = 1)"""


# vectors


@query(
    """SELECT id, score, similarity, label FROM (
        SELECT e.vec_id AS id, round(greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score,
            floor(greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) * 1000 + 0.5) / 1000 AS similarity, e.label
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
    WHERE score >= 0.25 ORDER BY score DESC, id LIMIT 10"""
)
def knn_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = embeddings(spark, sf_dir)
    asked = own.filter("id = 0").select(V.doubles("vector").alias("v")).first().v
    hits = search.nearest(own, asked, 10).filter("score >= 0.25")
    return hits.join(own.select("id", "label"), "id").select("id", F.round("score", 6).alias("score"), T.round3("score").alias("similarity"), "label")


@query(
    """SELECT query_id, id, score, rank FROM (
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM (
            SELECT q.vec_id AS query_id, e.vec_id AS id, round(greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score
            FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"""
)
def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = embeddings(spark, sf_dir)
    return search.nearest_batch(own, own.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), 10)


@query(
    f"""SELECT query_id, id, similarity, path, rank FROM (
        SELECT query_id, h.id, floor(score * 1000 + 0.5) / 1000 AS similarity, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, h.id)::INT AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (
                SELECT q.id AS query_id, c.id, c.file_id, round(greatest(0, list_cosine_similarity(c.v, q.v)), 6) AS score FROM {_CHUNKS} c, {_TAGS} q WHERE q.id % 100 = 0)
        ) h JOIN (SELECT DISTINCT id, path FROM files) f ON f.id = h.file_id WHERE r <= 20 AND score >= 0.25) WHERE rank <= 10"""
)
def knn_join_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = usable_chunks(spark, sf_dir).select("id", "file_id", "vector")
    asked = table(spark, sf_dir, "tags").filter(V.usable("vector", 64) & (F.col("id") % 100 == 0)).select(F.col("id").alias("query_id"), "vector").dropDuplicates(["query_id"])
    names = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path").distinct()
    meta = chunks.select("id", "file_id").distinct().join(names, "file_id")
    return search.basic_search(chunks.select("id", "vector"), meta, asked).select("query_id", "id", "similarity", "path", "rank")


@query(
    f"""SELECT query_id, tag_id, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tag_id)::INT AS rank FROM (
            SELECT q.id AS query_id, t.id AS tag_id, round(greatest(0, list_cosine_similarity(t.v, q.v)), 6) AS score FROM {_TAGS} t, {_CHUNKS} q WHERE q.id % 100 = 0)
    ) WHERE rank <= 15 AND score > 0.1"""
)
def tag_sensing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "tags").filter(V.usable("vector", 64)).select("id", "vector")
    top = search.nearest_batch(known, chunk_queries(spark, sf_dir), 15).filter("score > 0.1")
    return top.withColumnRenamed("id", "tag_id")


@query("SELECT count(*) AS vectors, max(len(embedding))::BIGINT AS dimensions, sum(len(embedding) * 4)::BIGINT AS memory_bytes FROM embeddings")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size("vector").cast("bigint")
    return embeddings(spark, sf_dir).agg(F.count("vector").alias("vectors"), F.max(size).alias("dimensions"), F.sum(size * 4).alias("memory_bytes"))


@query("SELECT (i - 1)::INT AS dimension, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY i")
def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.column_means(embeddings(spark, sf_dir), "vector").select("dimension", F.round("mean", 6).alias("mean"))


@query(
    """SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm,
        round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x)) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS unit_sum FROM embeddings"""
)
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = V.doubles("vector")
    return embeddings(spark, sf_dir).select("id", F.round(F.sqrt(V.dot(own, own)), 6).alias("norm"), F.round(V.total(V.normalize("vector")), 6).alias("unit_sum"))


@query(
    """WITH m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)
    SELECT a.label AS label_a, b.label AS label_b, round(list_cosine_similarity(a.c, b.c), 5) AS similarity FROM m a JOIN m b ON a.label < b.label"""
)
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = embeddings(spark, sf_dir).select("label", F.posexplode(V.doubles("vector")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    a, b = centre.withColumnsRenamed({"label": "label_a", "c": "x"}), centre.withColumnsRenamed({"label": "label_b", "c": "y"})
    # Ten labels, a fixed set.
    return a.join(F.broadcast(b), F.col("label_a") < F.col("label_b")).select("label_a", "label_b", F.round(V.cosine("x", "y"), 5).alias("similarity"))


@query()
def sensing_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = search.main_axes(usable_chunks(spark, sf_dir).select("id", "vector"))
    return search.sensing(axes, chunk_queries(spark, sf_dir)).select("query_id", F.round("logic_depth", 5).alias("logic_depth"), "mode")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "tag_cooccurrence").select("anchor_id", F.col("tag_a_id").alias("a"), F.col("tag_b_id").alias("b"), "weight")
    return own.distinct()


@query()
def boost_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "tags").select("id", "name", "vector").filter(V.usable("vector", 64))
    edges = _edges(spark, sf_dir).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    asked = materialise(search.sensing(search.main_axes(usable_chunks(spark, sf_dir).select("id", "vector")), chunk_queries(spark, sf_dir)), "sensed")
    out = search.boost(asked, known, edges)
    return out.select("query_id", F.size("matched").alias("matched"), F.round("beta", 5).alias("beta"), F.round("drift", 5).alias("drift"))


@query()
def enhanced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "tags").select("id", "name", "vector").filter(V.usable("vector", 64))
    edges = _edges(spark, sf_dir).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    chunks = usable_chunks(spark, sf_dir).select("id", "file_id", "content", "heading", "start_line", "end_line", "vector")
    return search.enhanced_search(chunks, known, edges, chunk_queries(spark, sf_dir)).select("query_id", "id", "similarity", "is_secondary", "rank", "mode")


@query()
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = search.systematic_sample(embeddings(spark, sf_dir).select("id", "vector"), 30).select(F.lit(1).alias("grp"), V.doubles("vector").alias("vector"))
    out = sample.groupBy("grp").applyInPandas(V.principal_axes(10), "grp int, axes array<array<double>>, strengths array<double>, k int")
    return out.select("k", F.posexplode("strengths").alias("axis", "strength")).withColumn("strength", F.round("strength", 5))


@query()
def tag_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of projection and residual of each query on its matched tags."""
    known = table(spark, sf_dir, "tags").filter(V.usable("vector", 64)).select("id", V.doubles("vector").alias("tv")).dropDuplicates(["id"])
    asked = chunk_queries(spark, sf_dir)
    top = search.nearest_batch(known.withColumnRenamed("tv", "vector"), asked, 15).filter("score > 0.1").join(known, "id")
    lists = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tv"))), lambda s: s["tv"]).alias("t"))
    out = asked.join(lists, "query_id").withColumn("p", V.project("vector", F.col("t")))
    norm = lambda c: F.round(F.sqrt(V.dot(F.col(c), F.col(c))), 5)
    return out.select("query_id", F.size("t").alias("tags"), norm("p.projection").alias("projection"), norm("p.residual").alias("residual"))


@query(
    """WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings)
    SELECT vec_id AS id FROM o WHERE place % greatest(1, n // 30) = 0 ORDER BY vec_id LIMIT 30"""
)
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.systematic_sample(embeddings(spark, sf_dir).select("id"), 30)


# terms and tags


@query(_DOC_TF)
def term_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT term, count(*) AS df FROM ({_DOC_TF}) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.document_counts(term_tf(spark, sf_dir))


@query(f"SELECT term, round(sum(tf) * ln(1 + (SELECT count(DISTINCT doc_id) FROM documents) / count(*)), 4) AS score FROM ({_DOC_TF}) GROUP BY term ORDER BY score DESC, term LIMIT 50")
def tfidf_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.choose_tags(table(spark, sf_dir, "documents"), "doc_id", "text")


_ASSIGNED = f"SELECT DISTINCT w.id, t.id AS tag_id FROM ({_terms_sql('chunks', 'id', 'content')}) w JOIN (SELECT DISTINCT id, name FROM tags) t ON t.name = w.term"


@query(_ASSIGNED)
def tag_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.assign_tags(table(spark, sf_dir, "chunks"), "id", "content", table(spark, sf_dir, "tags"))


@query(f"WITH s AS ({_ASSIGNED}) SELECT a.tag_id AS a, b.tag_id AS b, count(*) AS weight FROM s a JOIN s b ON a.id = b.id AND a.tag_id < b.tag_id GROUP BY 1, 2")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.edges_of(tag_assign(spark, sf_dir))


@query(
    f"""WITH b AS ({_BOTH}), n AS (SELECT anchor_id, b AS tag, a, weight FROM b WHERE weight >= 0.1 AND a % 100 = 0 AND b % 100 <> 0),
    m AS (SELECT anchor_id, tag, max(weight) AS weight FROM n GROUP BY 1, 2),
    s AS (SELECT m.anchor_id, m.tag, m.weight, min(n.a) AS source FROM m JOIN n ON n.anchor_id = m.anchor_id AND n.tag = m.tag AND n.weight = m.weight GROUP BY 1, 2, 3)
    SELECT anchor_id, tag, weight, source FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY weight DESC, tag) AS rn FROM s) WHERE rn <= 10"""
)
def tag_expand_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    seeds = edges.select("anchor_id", F.explode(F.array("a", "b")).alias("tag")).filter("tag % 100 = 0").distinct()
    return tags.expand_tags(edges, seeds, ["anchor_id"])


@query(f"SELECT anchor_id, a AS tag, least(count(DISTINCT b), 100) AS connections FROM ({_BOTH}) WHERE weight >= 0.01 GROUP BY 1, 2")
def tag_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.connections(_edges(spark, sf_dir), ["anchor_id"])


_SUMMED = "SELECT tag_a_id AS a, tag_b_id AS b, sum(weight) AS weight FROM (SELECT DISTINCT anchor_id, tag_a_id, tag_b_id, weight FROM tag_cooccurrence) GROUP BY 1, 2"


@query(
    f"""WITH e AS ({_SUMMED}), v AS (SELECT a, b FROM e WHERE weight >= 0.01 AND a <> b UNION SELECT b, a FROM e WHERE weight >= 0.01 AND a <> b),
    d AS (SELECT a AS id, least(count(DISTINCT b), 100) AS connections FROM v GROUP BY 1),
    t AS (SELECT DISTINCT id, name, weight FROM tags ORDER BY weight DESC NULLS LAST, name LIMIT 50)
    SELECT name, weight, coalesce(connections, 0) AS connections FROM t LEFT JOIN d USING (id)"""
)
def tag_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    return tags.list_tags(table(spark, sf_dir, "tags"), edges)


@query(
    f"""WITH e AS ({_SUMMED}), v AS (SELECT a, b, weight FROM e WHERE weight >= 0.01 AND a <> b UNION ALL SELECT b, a, weight FROM e WHERE weight >= 0.01 AND a <> b),
    s AS (SELECT min(a) AS id FROM v WHERE a IN (SELECT id FROM tags)),
    m AS (SELECT b AS tag, max(weight) AS weight FROM v, s WHERE a = s.id AND b <> s.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
    SELECT name, m.weight FROM m JOIN (SELECT DISTINCT id, name FROM tags) t ON t.id = m.tag"""
)
def tag_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What occurs together with the first tag that has edges."""
    known = table(spark, sf_dir, "tags").select("id", "name").distinct()
    edges = _edges(spark, sf_dir).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    linked = tags.both_ways(edges.filter("weight >= 0.01"), []).select(F.col("a").alias("id"))
    first = known.join(linked, "id", "left_semi").orderBy("id").first()
    return tags.inspect_tag(known, edges, first.name if first else "")


@query(
    f"""WITH l AS MATERIALIZED (SELECT DISTINCT id, term FROM ({_terms_sql('eval_items', 'item_id', 'text')})), r AS MATERIALIZED (SELECT DISTINCT id, term FROM ({_terms_sql('documents', 'doc_id', 'text')})),
    nl AS (SELECT id, count(*) AS n FROM l GROUP BY id), nr AS (SELECT id, count(*) AS n FROM r GROUP BY id),
    o AS (SELECT l.id AS x, r.id AS y, count(*) AS n FROM l JOIN r USING (term) GROUP BY 1, 2)
    SELECT o.x AS left_id, o.y AS right_id, round(o.n / (nl.n + nr.n - o.n), 6) AS similarity FROM o JOIN nl ON nl.id = o.x JOIN nr ON nr.id = o.y WHERE round(o.n / (nl.n + nr.n - o.n), 6) > 0.2"""
)
def jaccard_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("id"), "text")
    right = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return tags.similar_terms(left, right, 0.2)


# text functions


@query(
    """SELECT doc_id, CASE WHEN c = '' THEN text ELSE c END AS cleaned FROM (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '```[\\s\\S]*?```', '', 'g'), '`([^`]+)`', '\\1', 'g'), '[#*_~>|]', '', 'g'), '[\\s\\x0b\\x{85}\\x{a0}\\x{feff}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS c FROM documents)"""
)
def clean_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_query("text").alias("cleaned"))


@query(
    """SELECT doc_id, ceil(h * 1.5 + (u - h) / 4)::BIGINT AS tokens FROM (SELECT doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS h,
        length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10ffff}]')) AS u FROM documents)"""
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("hash"))


_EVERY = "(SELECT DISTINCT ON (id) id, 1 AS rank, 'file/' || file_id AS path, start_line, end_line, 0.5 AS similarity, content, heading FROM chunks)"


@query(f"WITH {_shown_sql(_EVERY)} SELECT id, 1 AS level, {_LEVEL_1} AS formatted, {_tokens_sql(_LEVEL_1)} AS tokens FROM f")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as its structural digest."""
    own = table(spark, sf_dir, "chunks").dropDuplicates(["id"])
    hits = own.select("id", F.lit(1).alias("rank"), F.concat(F.lit("file/"), F.col("file_id").cast("string")).alias("path"), "start_line", "end_line", F.lit(0.5).alias("similarity"), "content", "heading", F.lit(None).cast("array<string>").alias("matched"), F.lit(False).alias("is_secondary"))
    return fold.formatted(hits, F.lit(1)).select("id", "level", "formatted", "tokens")


@query(
    """SELECT id, CASE WHEN size < 1024 THEN size || 'B' WHEN size < 1048576 THEN printf('%.1f', size / 1024) || 'KB' ELSE printf('%.1f', size / 1048576) || 'MB' END AS shown
    FROM (SELECT DISTINCT id, size FROM files)"""
)
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", "size").distinct().select("id", T.format_size("size").alias("shown"))


_WANTED = ", ".join(f"'{e}'" for e in file_source.EXTENSIONS)
_IGNORED = ", ".join(f"'{e}'" for e in file_source.IGNORE)


@query(
    f"""SELECT id, path FROM (SELECT DISTINCT id, path FROM files) WHERE lower(regexp_extract(path, '[^/\\\\](\\.[^./\\\\]*)$', 1)) IN ({_WANTED})
    AND NOT list_has_any(string_split(replace(path, '\\', '/'), '/'), [{_IGNORED}])"""
)
def wanted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", "path").distinct().filter(T.wanted_path("path", list(file_source.EXTENSIONS), list(file_source.IGNORE)))


@query("SELECT doc_id, CASE WHEN source <> '' THEN concat_ws('/', source, path) ELSE concat_ws('/', path) END AS full_path FROM documents")
def prefixed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scopes.prefixed("path", "source").alias("full_path"))


@query("SELECT id, path, NOT (contains(path, '..') AND NOT starts_with(path, '/')) AS safe FROM (SELECT DISTINCT id, path FROM files)")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", "path").distinct().withColumn("safe", T.safe_relative("path"))


# models


@query(
    """SELECT id, model_id, CASE WHEN model_id LIKE 'text-embedding%' THEN 'openai' WHEN model_id LIKE 'models/%' THEN 'google' ELSE 'ollama' END AS provider FROM (SELECT DISTINCT id, model_id FROM model_meta)"""
)
def provider_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "model_meta").select("id", "model_id").distinct().withColumn("provider", T.infer_provider("model_id"))


@query(
    """WITH m AS (SELECT DISTINCT id, fingerprint, dimensions FROM model_meta), c AS (SELECT fingerprint, dimensions FROM model_meta WHERE is_active = 1 ORDER BY id LIMIT 1), s AS (SELECT unnest(['rebuild', 'warn', 'lazy']) AS strategy)
    SELECT id, strategy, CASE WHEN m.fingerprint IS NULL OR m.fingerprint = c.fingerprint THEN 'none' WHEN m.dimensions <> c.dimensions OR strategy = 'rebuild' THEN 'rebuild' ELSE 'warn' END AS action FROM m, c, s"""
)
def migration_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "model_meta").select("id", "fingerprint", "dimensions", "is_active").distinct()
    now = own.filter("is_active = 1").orderBy("id").first()
    matches = F.col("fingerprint").isNull() | (F.col("fingerprint") == F.lit(now.fingerprint))
    each = own.withColumn("strategy", F.explode(F.array(*map(F.lit, ("rebuild", "warn", "lazy")))))
    return each.select("id", "strategy", T.migration_action(matches, F.col("dimensions") != now.dimensions, F.col("strategy")).alias("action"))


@query()
def local_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = models.embed_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", models.hashing(64))
    return own.select("doc_id", F.size("vector").alias("width"), F.round(V.total(V.doubles("vector")), 4).alias("total"))


# scopes


def roots_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots as a tree at every size of the tables: one without a parent hangs below the root of half its number."""
    parent = F.coalesce("parent_id", F.nullif(F.expr("id div 2"), F.lit(0)))
    return table(spark, sf_dir, "anchors").select("id", "path", parent.alias("parent_id")).distinct()


@query(f"{_UP} SELECT id, ancestor_id, distance FROM up")
def scope_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.ancestors(roots_of(spark, sf_dir))


@query(f"{_MEMBERS} SELECT scope, id, member_id FROM m")
def scope_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = roots_of(spark, sf_dir)
    up = scopes.ancestors(roots)
    parts = [scopes.members(roots, up, s).select(F.lit(s).alias("scope"), "id", "member_id") for s in ("local", "bubble", "cascade", "merge")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    """WITH f AS (SELECT DISTINCT id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') AS p FROM files)
    SELECT f.id AS file_id, arg_max(a.id, len(string_split(a.path, '/'))) AS root_id FROM f JOIN anchors a ON f.p = a.path OR starts_with(f.p, a.path || '/') GROUP BY 1"""
)
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.nearest_root(table(spark, sf_dir, "files"), table(spark, sf_dir, "anchors"))


@query(
    f"""{_UP}, f AS (SELECT DISTINCT id, anchor_id FROM files WHERE anchor_id IS NOT NULL), c AS (SELECT file_id, count(DISTINCT id) AS n FROM chunks GROUP BY 1),
    o AS (SELECT anchor_id AS id, count(*) AS files, sum(coalesce(n, 0)) AS chunks FROM f LEFT JOIN c ON c.file_id = f.id GROUP BY 1),
    b AS (SELECT id, id AS m FROM r UNION ALL SELECT ancestor_id, id FROM up)
    SELECT b.id, coalesce(sum(o.files), 0)::BIGINT AS files, coalesce(sum(o.chunks), 0)::BIGINT AS chunks FROM b LEFT JOIN o ON o.id = b.m GROUP BY 1"""
)
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = roots_of(spark, sf_dir)
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "anchor_id").distinct().filter("anchor_id is not null")
    chunks = table(spark, sf_dir, "chunks").select("id", "file_id").distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    own = files.join(chunks, "file_id", "left").groupBy(F.col("anchor_id").alias("id")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("chunks"))
    return scopes.subtree_totals(roots, scopes.ancestors(roots), own, ["files", "chunks"])


@query(
    f"""{_MEMBERS}, f AS (SELECT DISTINCT id, path, anchor_id AS g FROM files), c AS (SELECT c.id, c.v, f.path, f.g, s.start_line FROM {_CHUNKS} c JOIN f ON f.id = c.file_id JOIN (SELECT DISTINCT ON (id) id, start_line FROM chunks) s ON s.id = c.id WHERE f.g IS NOT NULL),
    h AS (SELECT m.scope, q.id AS query_id, c.g, c.id, c.path, c.start_line, round(greatest(0, list_cosine_similarity(c.v, q.v)), 6) AS score FROM c q JOIN m ON m.id = q.g JOIN c ON c.g = m.member_id WHERE q.id % 100 = 0),
    t AS (SELECT scope, query_id, id, path, start_line, floor(score * 1000 + 0.5) / 1000 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY scope, query_id, g ORDER BY score DESC, id) AS rn FROM h WHERE score >= 0.25) WHERE rn <= 10),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, query_id, path, start_line ORDER BY similarity DESC, id) AS rn FROM t) WHERE rn = 1)
    SELECT scope, query_id, id, path, start_line, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY scope, query_id ORDER BY similarity DESC, path, start_line NULLS FIRST, id)::INT AS rank FROM d) WHERE rank <= 10"""
)
def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query chunk searched from its own root, in each of the four scopes."""
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path", F.col("anchor_id").alias("group")).distinct().filter("anchor_id is not null")
    chunks = usable_chunks(spark, sf_dir).select("id", "file_id", "start_line", "vector").join(files, "file_id")
    asked = chunks.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("group").alias("root_id"), "vector").dropDuplicates(["query_id"])
    asked = materialise(asked, "asked")
    roots = roots_of(spark, sf_dir)
    up = scopes.ancestors(roots)
    out = None
    for scope in ("local", "bubble", "cascade", "merge"):
        hits = search.scoped_search(chunks.select("id", "vector", "group"), chunks.select("id", "path", "start_line"), asked, scopes.members(roots, up, scope))
        named = hits.select(F.lit(scope).alias("scope"), "query_id", "id", "path", "start_line", "similarity", "rank")
        out = named if out is None else out.unionByName(named)
    return out


# folding

_HITS = f"""SELECT query_id, id, similarity, rank, CASE WHEN query_id % 200 = 0 THEN 0.7 ELSE 0.5 END AS logic_depth FROM (
    SELECT query_id, id, floor(score * 1000 + 0.5) / 1000 AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM (
        SELECT q.id AS query_id, c.id, round(greatest(0, list_cosine_similarity(c.v, q.v)), 6) AS score FROM {_CHUNKS} c, {_CHUNKS} q WHERE q.id % 100 = 0)) WHERE rank <= 10"""
_LIMITS = f"""SELECT query_id, greatest(0.3, avg(similarity) + stddev_pop(similarity) * CASE WHEN max(logic_depth) > 0.6 THEN 0.3 ELSE 0.8 END) AS f, greatest(0.2, avg(similarity) - stddev_pop(similarity) * 0.3) AS s FROM ({_HITS}) GROUP BY 1"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.nearest_batch(usable_chunks(spark, sf_dir).select("id", "vector"), chunk_queries(spark, sf_dir), 10)
    return found.withColumn("similarity", T.round3("score")).withColumn("logic_depth", F.when(F.col("query_id") % 200 == 0, 0.7).otherwise(0.5))


@query(f"SELECT query_id, round(f, 6) AS full_threshold, round(s, 6) AS summary_threshold FROM ({_LIMITS})")
def fold_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold.thresholds(_hits(spark, sf_dir))
    return out.select("query_id", F.round("full_threshold", 6).alias("full_threshold"), F.round("summary_threshold", 6).alias("summary_threshold"))


@query(f"SELECT query_id, id, rank, similarity, CASE WHEN similarity >= round(f, 9) THEN 3 WHEN similarity >= round(s, 9) THEN 1 ELSE 0 END AS level FROM ({_HITS}) h JOIN ({_LIMITS}) l USING (query_id)")
def fold_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    joined = hits.join(fold.thresholds(hits), "query_id")
    return joined.select("query_id", "id", "rank", "similarity", fold.level_of(F.col("similarity"), F.round("full_threshold", 9), F.round("summary_threshold", 9)).alias("level"))


@query(
    f"""SELECT level, count(*) AS hits FROM (SELECT CASE WHEN similarity >= round(f, 9) THEN 3 WHEN similarity >= round(s, 9) THEN 1 ELSE 0 END AS level FROM ({_HITS}) h JOIN ({_LIMITS}) l USING (query_id)) GROUP BY 1"""
)
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_levels(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("hits"))


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path").distinct()
    body = table(spark, sf_dir, "chunks").select("id", "file_id", "content", "heading", "start_line", "end_line")
    own = _hits(spark, sf_dir).join(body, "id").dropDuplicates(["query_id", "id"]).join(names, "file_id", "left").withColumns({"matched": F.lit(None).cast("array<string>"), "is_secondary": F.lit(False)})
    return own.withColumn("path", F.coalesce("path", F.lit("?")))


_HIT_PAGE = f"""(SELECT h.query_id, h.id, h.rank, h.similarity, round(l.f, 9) AS full_at, round(l.s, 9) AS summary_at, coalesce(p.path, '?') AS path, c.start_line, c.end_line, c.content, c.heading
    FROM ({_HITS}) h JOIN ({_LIMITS}) l USING (query_id) JOIN (SELECT DISTINCT ON (id) * FROM chunks) c ON c.id = h.id LEFT JOIN (SELECT DISTINCT id, path FROM files) p ON p.id = c.file_id)"""
_PRICED = f"""{_shown_sql(_HIT_PAGE)}, t AS MATERIALIZED (SELECT query_id, rank, similarity, full_at, summary_at, {_tokens_sql("head")} AS t0, {_tokens_sql(_LEVEL_1)} AS t1, {_tokens_sql(_LEVEL_3)} AS t3 FROM f)"""
_SUMMED_LEVELS = "count(*) AS shown, count(*) FILTER (level = 3) AS complete, count(*) FILTER (level = 1) AS digests, count(*) FILTER (level = 0) AS folded, sum(CASE level WHEN 3 THEN t3 WHEN 1 THEN t1 ELSE t0 END)::BIGINT AS tokens"


@query(
    f"""WITH RECURSIVE {_PRICED}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rank) AS k, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r, sum(t0) OVER (PARTITION BY query_id) AS least FROM t),
    one(query_id, k, used, level) AS (SELECT DISTINCT query_id, 0::BIGINT, least::HUGEINT, 0 FROM o WHERE least <= 500 UNION ALL
        SELECT o.query_id, o.k, one.used + CASE WHEN one.used + o.t1 - o.t0 <= 500 THEN o.t1 - o.t0 ELSE 0 END, CASE WHEN one.used + o.t1 - o.t0 <= 500 THEN 1 ELSE 0 END FROM one JOIN o ON o.query_id = one.query_id AND o.k = one.k + 1),
    two(query_id, k, used, level) AS (SELECT query_id, 0::BIGINT, arg_max(used, k), 0 FROM one GROUP BY 1 UNION ALL
        SELECT x.query_id, x.k, two.used + CASE WHEN two.used + x.more <= 500 AND x.similarity >= x.full_at THEN x.more ELSE 0 END, CASE WHEN two.used + x.more <= 500 AND x.similarity >= x.full_at THEN 3 ELSE x.level END
        FROM two JOIN (SELECT o.*, one.level, o.t3 - CASE WHEN one.level = 1 THEN o.t1 ELSE o.t0 END AS more FROM o JOIN one ON one.query_id = o.query_id AND one.k = o.k) x ON x.query_id = two.query_id AND x.k = two.k + 1),
    l AS (SELECT o.*, two.level FROM o JOIN two ON two.query_id = o.query_id AND two.k = o.k
        UNION ALL SELECT *, 0 FROM (SELECT o.* FROM o WHERE least > 500 QUALIFY sum(t0) OVER (PARTITION BY query_id ORDER BY r) <= 500))
    SELECT query_id, {_SUMMED_LEVELS} FROM l GROUP BY 1"""
)
def fold_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.summary(fold.fold_budget(_page(spark, sf_dir), 500))


@query(f"WITH {_PRICED}, l AS (SELECT *, CASE WHEN similarity >= full_at THEN 3 WHEN similarity >= summary_at THEN 1 ELSE 0 END AS level FROM t) SELECT query_id, {_SUMMED_LEVELS} FROM l GROUP BY 1")
def fold_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.summary(fold.fold(_page(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {_shown_sql(_HIT_PAGE)}, w AS MATERIALIZED (SELECT query_id, id, rank, list_distinct(own) AS w FROM b),
    k(query_id, rank, kept) AS (SELECT DISTINCT query_id, 0, []::STRUCT(id BIGINT, rank INT, w VARCHAR[])[] FROM w UNION ALL
        SELECT w.query_id, w.rank, CASE WHEN len(list_filter(k.kept, lambda x: len(x.w) > 0 AND len(w.w) > 0 AND len(list_intersect(x.w, w.w)) / len(list_distinct(list_concat(x.w, w.w))) > 0.9)) > 0 THEN k.kept
            ELSE list_append(k.kept, {{'id': w.id, 'rank': w.rank, 'w': w.w}}) END FROM k JOIN w ON w.query_id = k.query_id AND w.rank = k.rank + 1),
    e AS (SELECT query_id, unnest(arg_max(kept, rank)[1:10]) AS h FROM k GROUP BY 1)
    SELECT query_id, h.id AS id, h.rank AS rank FROM e"""
)
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = _page(spark, sf_dir).withColumn("words", search.words_of(F.coalesce("content", F.lit(""))))
    return search.semantic_dedup(page, 0.9, 10).select("query_id", "id", "rank")


@query(
    """SELECT id, file_id, start_line, lag(id) OVER w AS before_id, lead(id) OVER w AS after_id FROM (SELECT DISTINCT id, file_id, start_line FROM chunks)
    WINDOW w AS (PARTITION BY file_id ORDER BY start_line NULLS FIRST, id)"""
)
def adjacent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.neighbours(table(spark, sf_dir, "chunks"))


@query(
    """SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10"""
)
def latest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "event_id", "ts", F.struct("ts", "event_id").alias("seq"))
    return fold.latest_sessions(own).select(F.col("client").alias("user_id"), "event_id", "ts")


# chunking


def _chunk_query(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = chunkers.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "path", "text", kind=kind)
        return own.select(F.col("id").alias("doc_id"), "chunk_index", "heading", "start_line", "end_line", F.length("content").alias("n_chars"), T.content_hash("content").alias("hash"))

    return run


_QUERIES |= {"chunk_text": _chunk_query("text"), "chunk_markdown": _chunk_query("markdown"), "chunk_router": _chunk_query("auto")}


# synchronisation

_BEFORE = "SELECT path, CASE WHEN id % 7 = 0 THEN 'old' ELSE hash END AS hash FROM files WHERE id % 11 <> 0 UNION ALL SELECT 'gone/' || path, hash FROM files WHERE id % 13 = 0"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files as they are, and an earlier state made of them: some changed, some new since, some gone since."""
    now = table(spark, sf_dir, "files").select("id", "path", "hash")
    stayed = now.filter("id % 11 <> 0").select("path", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    gone = now.filter("id % 13 = 0").select(F.concat(F.lit("gone/"), "path").alias("path"), "hash")
    return now.select("path", "hash"), stayed.unionByName(gone)


_DIFF = f"""SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.hash IS DISTINCT FROM o.hash THEN 'updated' ELSE 'same' END AS status
    FROM (SELECT path, min(hash) AS hash FROM files GROUP BY path) n FULL OUTER JOIN (SELECT path, min(hash) AS hash FROM ({_BEFORE}) GROUP BY path) o ON n.path = o.path"""


@query(_DIFF)
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.changes(*_states(spark, sf_dir))


@query(f"SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'removed') AS removed FROM ({_DIFF})")
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.change_counts(sync_diff(spark, sf_dir))


@query(
    f"""WITH d AS ({_DIFF}), c AS (SELECT DISTINCT c.id, f.path, c.start_line, c.chunk_index FROM chunks c JOIN (SELECT DISTINCT id, path FROM files) f ON f.id = c.file_id),
    keep AS (SELECT id, path FROM c WHERE path NOT IN (SELECT path FROM d WHERE status IN ('updated', 'removed'))),
    come AS (SELECT path, (SELECT max(id) FROM c) + row_number() OVER (ORDER BY path, start_line NULLS FIRST, chunk_index) AS id FROM c WHERE path IN (SELECT path FROM d WHERE status IN ('added', 'updated')))
    SELECT id, path FROM keep UNION ALL SELECT id, path FROM come"""
)
def sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path").distinct()
    chunks = table(spark, sf_dir, "chunks").select("id", "file_id", "start_line", "chunk_index").distinct().join(names, "file_id").drop("file_id")
    return sync.apply_changes(chunks, chunks.drop("id"), sync_diff(spark, sf_dir)).select("id", "path")


@query(
    """SELECT f.path, arg_min(f.hash, c.id) AS hash FROM (SELECT DISTINCT id, file_id FROM chunks) c JOIN (SELECT DISTINCT id, path, hash FROM files) f ON f.id = c.file_id GROUP BY 1"""
)
def indexed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path", "hash").distinct()
    own = table(spark, sf_dir, "chunks").select("id", "file_id").distinct().join(names, "file_id")
    return sync.indexed_hashes(own)


@query("SELECT (SELECT max(id) FROM files) + row_number() OVER (ORDER BY path, doc_id) AS id, doc_id FROM (SELECT DISTINCT doc_id, path FROM documents WHERE path IS NOT NULL)")
def id_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", "path").filter("path is not null").distinct()
    top = table(spark, sf_dir, "files").agg(F.max("id")).first()[0] or 0
    return sync.numbered(own, ["path", "doc_id"], top).select("id", "doc_id")


@query("SELECT DISTINCT id, file_id FROM chunks WHERE stale = 0 AND vector IS NOT NULL")
def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").filter("stale = 0 and vector is not null").select("id", "file_id").distinct()


@query(
    """SELECT a.id AS anchor_id, count(DISTINCT f.id) AS files, count(DISTINCT c.id) AS chunks, count(DISTINCT c.id) FILTER (c.vector IS NOT NULL) AS vectors
    FROM (SELECT DISTINCT id FROM anchors) a LEFT JOIN files f ON f.anchor_id = a.id LEFT JOIN chunks c ON c.file_id = f.id GROUP BY 1"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "anchors").select(F.col("id").alias("anchor_id")).distinct()
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "anchor_id").distinct()
    each = table(spark, sf_dir, "chunks").select("id", "file_id", F.col("vector").isNotNull().alias("v")).distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("c"), F.count_if("v").alias("v"))
    own = files.join(each, "file_id", "left").groupBy("anchor_id").agg(F.count(F.lit(1)).alias("files"), F.sum("c").alias("chunks"), F.sum("v").alias("vectors"))
    zero = F.lit(0).cast("bigint")
    return roots.join(own, "anchor_id", "left").select("anchor_id", *(F.coalesce(c, zero).alias(c) for c in ("files", "chunks", "vectors")))


@query(
    """SELECT f.anchor_id, t.file_id, t.tag_id, date_trunc('hour', t.tagged_at) AS hour, count(*) AS n
    FROM (SELECT DISTINCT * FROM file_tags) t JOIN (SELECT DISTINCT id, anchor_id FROM files) f ON f.id = t.file_id GROUP BY ALL"""
)
def tag_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: how often tags arrive at files, by the hour."""
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "anchor_id").distinct()
    own = table(spark, sf_dir, "file_tags").distinct().join(files, "file_id")
    return own.groupBy("anchor_id", "file_id", "tag_id", F.date_trunc("hour", "tagged_at").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
