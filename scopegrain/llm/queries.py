"""The training-data queries and, where SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scopegrain.llm import bpe, handwritten, leakage, neardup, quality, split, together, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": vectors.p1_found,
        "p2_found": together.p2_found,
        "p3_found": neardup.p3_found,
        "p3_classes": neardup.p3_classes,
        "p3_pairs": neardup.p3_pairs,
        "p3_chunk_classes": neardup.p3_chunk_classes,
        "p3_chunk_pairs": neardup.p3_chunk_pairs,
        "p4_found": handwritten.p4_found,
        "p4_validation": handwritten.p4_validation,
        "p5_found": split.p5_found,
        "p6_ids": bpe.p6_ids,
        "p7_found": leakage.p7_found,
        "p8_found": quality.p8_found,
        "p8_labels": quality.p8_labels,
        "p8_statistics": quality.p8_statistics,
    }


_USABLE = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_CHUNKS = f"(SELECT DISTINCT ON (id) id, vector::DOUBLE[] AS v FROM chunks WHERE {_USABLE})"
_TAGS = f"(SELECT DISTINCT ON (id) id, vector::DOUBLE[] AS v FROM tags WHERE {_USABLE})"

_P1 = f"""WITH c AS MATERIALIZED {_CHUNKS}, t AS MATERIALIZED {_TAGS},
    n AS (SELECT a.id AS chunk_id, 'chunk' AS neighbour_kind, b.id AS neighbour_id, round(list_cosine_similarity(a.v, b.v), 6) AS s, 0.88 AS least, 5 AS k FROM c a JOIN c b ON a.id <> b.id
    UNION ALL SELECT a.id, 'tag', b.id, round(list_cosine_similarity(a.v, b.v), 6), 0.5, 3 FROM c a, t b)
    SELECT chunk_id, neighbour_kind, neighbour_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, neighbour_kind ORDER BY s DESC, neighbour_id) AS rn FROM n WHERE s >= least) WHERE rn <= k"""

_P2 = """WITH ft AS (SELECT DISTINCT f.anchor_id AS g, t.file_id AS b, t.tag_id AS t FROM file_tags t JOIN (SELECT DISTINCT id, anchor_id FROM files WHERE anchor_id IS NOT NULL) f ON f.id = t.file_id WHERE t.tag_id IN (SELECT id FROM tags)),
    n AS (SELECT g, count(DISTINCT b) AS n FROM ft GROUP BY 1), s AS (SELECT g, t, count(*) AS c FROM ft GROUP BY 1, 2),
    p AS (SELECT a.g, a.t AS ta, b.t AS tb, count(*) AS nab FROM ft a JOIN ft b ON a.g = b.g AND a.b = b.b AND a.t < b.t GROUP BY 1, 2, 3),
    e AS (SELECT anchor_id AS g, least(tag_a_id, tag_b_id) AS ta, greatest(tag_a_id, tag_b_id) AS tb, sum(coalesce(weight, 0)) AS w FROM (SELECT DISTINCT * FROM tag_cooccurrence) WHERE tag_a_id IS NOT NULL AND tag_b_id IS NOT NULL GROUP BY 1, 2, 3)
    SELECT p.g AS anchor_id, p.ta AS tag_a_id, p.tb AS tag_b_id, CASE WHEN w IS NULL THEN 'absent' WHEN w = nab THEN 'same' ELSE 'differs' END AS verdict
    FROM p JOIN n ON n.g = p.g JOIN s x ON x.g = p.g AND x.t = p.ta JOIN s y ON y.g = p.g AND y.t = p.tb LEFT JOIN e ON e.g = p.g AND e.ta = p.ta AND e.tb = p.tb
    WHERE nab >= 6 AND nab * n >= 3 * x.c * y.c"""

_P3 = f"""WITH w AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL)),
    g AS MATERIALIZED (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30),
    n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
    o AS (SELECT a.id AS x, b.id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
    c AS MATERIALIZED {_CHUNKS}
    SELECT x AS chunk_a, y AS chunk_b FROM o JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE 10 * o >= 6 * (p.n + q.n - o)
    UNION SELECT a.id, b.id FROM c a JOIN c b ON a.id < b.id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.985"""

_CHUNK_CLASSES = f"""w AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL)),
    g AS MATERIALIZED (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 30),
    v AS MATERIALIZED {_CHUNKS},
    m AS MATERIALIZED (SELECT 'text' AS kind, id, array_to_string(g, '|') AS k FROM g UNION ALL SELECT 'vector', id, v::VARCHAR FROM v),
    f AS MATERIALIZED (SELECT kind, k, min(id) AS class_id, count(*) AS members FROM m GROUP BY 1, 2),
    s AS MATERIALIZED (SELECT class_id, len(g) AS n, unnest(g) AS s FROM f JOIN g ON g.id = class_id WHERE kind = 'text'),
    o AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS o, any_value(a.n) AS p, any_value(b.n) AS q FROM s a JOIN s b ON a.s = b.s AND a.class_id < b.class_id GROUP BY 1, 2),
    c AS MATERIALIZED (SELECT class_id, v FROM f JOIN v ON v.id = class_id WHERE kind = 'vector'),
    l AS MATERIALIZED (SELECT 'text' AS kind, x, y FROM o WHERE 10 * o >= 6 * (p + q - o)
        UNION ALL SELECT 'vector', a.class_id, b.class_id FROM c a JOIN c b ON a.class_id < b.class_id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.985)"""
_P3_CHUNK_CLASSES = f"""WITH {_CHUNK_CLASSES}, n AS (SELECT kind, c, count(*) AS n FROM (SELECT kind, x AS c FROM l UNION ALL SELECT kind, y FROM l) GROUP BY 1, 2)
    SELECT m.kind, m.id AS chunk_id, class_id, members, coalesce(n.n, 0) AS links FROM m JOIN f ON f.kind = m.kind AND f.k = m.k LEFT JOIN n ON n.kind = m.kind AND n.c = class_id"""
_P3_CHUNK_PAIRS = f"WITH {_CHUNK_CLASSES} SELECT kind, x AS class_a, y AS class_b FROM l"

_P7 = """WITH d AS (SELECT DISTINCT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
    e AS (SELECT DISTINCT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
    x AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS s FROM d WHERE len(w) >= 12),
    y AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS s FROM e WHERE len(w) >= 12)
    SELECT DISTINCT x.id AS doc_id, y.id AS item_id FROM x JOIN y ON x.s = y.s"""


# One step a piece: where the text that remains is too long, the best kind of cut in reach, and of that kind the last.
_P5 = f"""WITH RECURSIVE c AS (SELECT DISTINCT id, content AS t, coalesce(start_line, 1)::BIGINT AS line FROM chunks WHERE id IS NOT NULL AND length(content) > 512),
    p(id, t, line, n, s, e) AS (
        SELECT id, t, line, 0::BIGINT, 0::BIGINT, 64::BIGINT FROM c
        UNION ALL
        SELECT id, t, line, n + 1, e - 64, CASE WHEN length(t) - (e - 64) <= 512 THEN length(t) ELSE coalesce(
            list_max(list_filter(range(e + 192, e + 449), lambda x: substr(t, x, 1) = chr(10) AND regexp_matches(substr(t, x + 1, 8), '^#{{1,6}} '))),
            list_max(list_filter(range(e + 192, e + 449), lambda x: substr(t, x, 1) = chr(10) AND regexp_matches(substr(t, 1, x - 1), '(^|\\n)[ \\t\\r]*$'))),
            list_max(list_filter(range(e + 192, e + 449), lambda x: substr(t, x, 1) = chr(10))),
            list_max(list_filter(range(e + 192, e + 449), lambda x: substr(t, x, 1) IN (' ', chr(9)))), e + 448) END
        FROM p WHERE n = 0 OR e < length(t))
    SELECT id AS chunk_id, n AS piece_no, s AS char_start, e AS char_end, line + length(substr(t, 1, s)) - length(replace(substr(t, 1, s), chr(10), '')) AS line_start,
        line + length(substr(t, 1, e - 1)) - length(replace(substr(t, 1, e - 1), chr(10), '')) AS line_end FROM p WHERE n > 0"""

_SHINGLED = """t AS (SELECT DISTINCT doc_id AS id, text AS t FROM documents WHERE doc_id IS NOT NULL), w AS (SELECT id, t, coalesce(regexp_extract_all(lower(t), '[a-z0-9_]+'), []) AS w FROM t),
    g AS MATERIALIZED (SELECT id, t, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w),
    m AS MATERIALIZED (SELECT id, CASE WHEN len(g) > 0 THEN 'g' || md5(array_to_string(g, '|')) WHEN t IS NOT NULL THEN 't' || t ELSE 'i' || id END AS k, g FROM g),
    f AS MATERIALIZED (SELECT k, min(id) AS class_id, count(*) AS members, any_value(g) AS g FROM m GROUP BY k),
    s AS (SELECT class_id, len(g) AS n, unnest(g) AS s FROM f),
    o AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS o, any_value(a.n) AS p, any_value(b.n) AS q FROM s a JOIN s b ON a.s = b.s AND a.class_id < b.class_id GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT x, y, round(o / (p + q - o), 6) AS similarity FROM o WHERE 10 * o >= 8 * (p + q - o))"""
_P3_CLASSES = f"""WITH {_SHINGLED}, n AS (SELECT c, count(*) AS n FROM (SELECT x AS c FROM l UNION ALL SELECT y FROM l) GROUP BY 1)
    SELECT m.id AS doc_id, class_id, members, coalesce(n.n, 0) AS links FROM m JOIN f ON f.k = m.k LEFT JOIN n ON n.c = f.class_id"""
_P3_PAIRS = f"WITH {_SHINGLED} SELECT x AS class_a, y AS class_b, similarity FROM l"

_P8 = f"""WITH k AS (SELECT list(word) AS k FROM (SELECT word FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}{{2,}}'))) AS word FROM documents) GROUP BY word ORDER BY count(*) DESC, word LIMIT {quality.FREQUENT})),
    d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '\\p{{L}}+') AS w, length(regexp_replace(t, '[\\s\\x0b]', '', 'g')) AS n,
        list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\s\\x0b]', '', 'g') <> '') AS l FROM d)
    SELECT doc_id, len(w)::BIGINT AS words, CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, '')) / len(w), 6) END AS mean_word_length,
        CASE WHEN n > 0 THEN round(length(regexp_replace(t, '[\\s\\x0b\\p{{L}}\\p{{N}}]', '', 'g')) / n, 6) END AS symbol_ratio,
        CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?。！？][\\s\\x0b]*$'))) / len(l), 6) END AS end_punctuation_share,
        CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(k, x))) / len(w), 6) END AS common_word_share FROM w, k"""


def oracle_sql() -> dict[str, str]:
    """p4 and p8_found are learned, p6 iterates: they are tested against held-out labels and a public library."""
    return {"p1_found": _P1, "p2_found": _P2, "p3_found": _P3, "p3_classes": _P3_CLASSES, "p3_pairs": _P3_PAIRS, "p3_chunk_classes": _P3_CHUNK_CLASSES, "p3_chunk_pairs": _P3_CHUNK_PAIRS, "p5_found": _P5, "p7_found": _P7, "p8_statistics": _P8}
