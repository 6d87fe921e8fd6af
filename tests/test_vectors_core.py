import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopegrain.functions import vector as V
from scopegrain.operators import search, tags


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def arr(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_svd_of_a_centred_cross():
    axes, strengths = V.decompose(np.array([[2, 0, 0], [0, 2, 0], [-2, 0, 0], [0, -2, 0]], float), 3)
    assert len(strengths) == 2 and axes.shape == (2, 3)
    assert strengths == pytest.approx([math.sqrt(8)] * 2)


def test_svd_of_one_row():
    axes, strengths = V.decompose(np.array([[1.0, 2, 3]]), 1)
    assert len(strengths) == 1 and not axes.any()


def test_cosine_and_normalize(spark):
    row = one(spark, o=V.cosine(arr(1, 0, 0), arr(0, 1, 0)), p=V.cosine(arr(1, 2, 0), arr(2, 4, 0)), a=V.cosine(arr(1, 0), arr(-1, 0)), w=V.cosine(arr(1, 0), arr(1, 0, 0)), z=V.cosine(arr(0, 0), arr(1, 0)), n=V.normalize(arr(3, 4)), s=V.score(arr(1, 0), arr(-1, 0)))
    assert (row.o, row.p, row.a, row.w, row.z, row.s) == pytest.approx((0, 1, -1, 0, 0, 0))
    assert row.n == pytest.approx([0.6, 0.8])


def test_projection_in_span_with_residual_and_dependent_vectors(spark):
    p = one(spark, p=V.project(arr(3, 4, 0), F.array(arr(1, 0, 0), arr(0, 1, 0)))).p
    assert p.projection == pytest.approx([3, 4, 0]) and p.residual == pytest.approx([0, 0, 0]) and p.coefficients == pytest.approx([3, 4])
    p = one(spark, p=V.project(arr(1, 1, 5), F.array(arr(1, 0, 0), arr(2, 0, 0), arr(0, 0, 0)))).p
    assert p.residual == pytest.approx([0, 1, 5]) and p.coefficients == pytest.approx([1, 0, 0])


def test_projection_is_orthogonal(spark):
    rng = np.random.default_rng(1)
    q, t = rng.normal(size=16), rng.normal(size=(5, 16))
    p = one(spark, p=V.project(arr(*q), F.array(*(arr(*x) for x in t)))).p
    assert np.array(p.projection) + np.array(p.residual) == pytest.approx(q)
    assert t @ np.array(p.residual) == pytest.approx(np.zeros(5), abs=1e-9)


def test_energy_profiles(spark):
    basis = F.array(arr(1, 0, 0), arr(0, 1, 0))
    e = one(spark, e=V.energy_profile(arr(1, 0, 0), basis, arr(0, 0, 0))).e
    assert e.projections == pytest.approx([1, 0]) and e.probabilities[0] == pytest.approx(1) and e.entropy < 0.01
    e = one(spark, e=V.energy_profile(arr(2**-0.5, 2**-0.5, 0), basis, arr(0, 0, 0))).e
    assert e.entropy == pytest.approx(math.log(2))
    e = one(spark, e=V.energy_profile(arr(0, 0, 1), basis, arr(0, 0, 0))).e
    assert e.probabilities == pytest.approx([0.5, 0.5])


@pytest.mark.parametrize("depth", [0.0, 0.5, 1.0])
def test_beta_lies_in_its_range(spark, depth):
    row = one(spark, b=V.beta(F.lit(depth), F.lit(7), F.lit(9)), none=V.beta(F.lit(depth), F.lit(0), F.lit(9)))
    assert 0.3 - 1e-9 <= row.b <= 0.3667 and row.none == 0


def test_expansion_by_one_step(spark):
    edges = spark.createDataFrame([(1, 3, 0.8), (1, 4, 0.3), (2, 5, 0.9), (3, 4, 0.5), (4, 5, 0.2), (1, 1, 1.0), (1, None, 1.0)], "a bigint, b bigint, weight double")
    seeds = spark.createDataFrame([(1,), (2,)], "tag bigint")
    found = [(r.tag, r.weight, r.source) for r in tags.expand_tags(edges, seeds, []).orderBy(F.desc("weight")).collect()]
    assert found == [(5, 0.9, 2), (3, 0.8, 1), (4, 0.3, 1)]


def test_batch_search_equals_brute_force_with_repeated_dirty_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(60)] * 2 + [(99, None), (98, [float("nan")] * 8), (97, [0.0] * 8), (96, [1.0])]
    vectors = spark.createDataFrame(rows, "id bigint, vector array<float>")
    asked = spark.createDataFrame([(0, x[0].tolist()), (1, x[1].tolist())], "query_id bigint, vector array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for q in (0, 1):
        s = np.round(np.maximum(0, u @ u[q]), 6)
        best = sorted(range(60), key=lambda i: (-s[i], i))[:5]
        got = search.nearest_batch(vectors, asked, 5).filter(F.col("query_id") == q).orderBy("rank").collect()
        assert [r.id for r in got] == best
    assert search.nearest_batch(vectors.limit(0), asked, 5).count() == 0
    assert search.nearest_batch(vectors, asked.limit(0), 5).count() == 0


def test_greedy_dedup_depends_on_order(spark):
    rows = [(1, 1, list("abcdefghij")), (1, 2, list("abcdefghi")), (1, 3, list("abcdefgh")), (1, 4, []), (1, 5, [])]
    hits = spark.createDataFrame(rows, "query_id bigint, rank int, words array<string>")
    kept = {r["rank"] for r in search.semantic_dedup(hits, 0.85).collect()}
    assert kept == {1, 3, 4, 5}


def test_second_search_past_the_drift_gate(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "id bigint, vector array<double>")
    moved = spark.createDataFrame([(0, [1.0, 0.0], [0.0, 1.0], 1.0)], "query_id bigint, vector array<double>, boosted array<double>, drift double")
    got = {(r.id, r.is_secondary) for r in search.retrieve(vectors, moved, search.SearchParams(top_k=1)).collect()}
    assert (2, False) in got and (1, False) not in got


def test_boost_in_numpy_equals_the_column_functions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6):
        tags = rng.normal(size=(i, 5))
        tags[-1:] = tags[:1]
        rows.append((i, rng.normal(size=5).tolist(), tags.tolist(), rng.uniform(size=i).tolist(), rng.normal(size=(2, 5)).tolist() if i % 2 else None, 0.35))
    frame = spark.createDataFrame(rows, "i int, v array<double>, t array<array<double>>, s array<double>, e array<array<double>>, w double")
    for residual in (True, False):
        matched = F.zip_with("t", "s", lambda t, s: F.struct(t.alias("vector"), s.alias("similarity")))
        spanned = F.concat("t", F.coalesce("e", F.array().cast("array<array<double>>")))
        rest = V.project("v", spanned)["residual"] if residual else F.lit(None).cast("array<double>")
        want = F.when(F.size("t") == 0, F.col("v")).otherwise(V.fuse("v", matched, rest, F.col("w")))
        for r in frame.select(V.boosting(residual)("v", "t", "s", "e", "w").alias("got"), want.alias("want")).collect():
            assert np.allclose(r.got, r.want)
