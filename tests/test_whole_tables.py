"""Queries that must cover whole tables, against brute force on fixtures."""

from collections import Counter
from datetime import datetime

import numpy as np
import pytest

from pyspark.sql import functions as F

from scopegrain.operators import scopes, search, sync, tags
from scopegrain.plans import catalogue


def test_arrivals_of_all_tags_are_counted(spark, tmp_path):
    files = [(1, 10), (2, 10), (3, None), (1, 10)]
    at = lambda h, m: datetime(2025, 1, 2, h, m)
    tagged = [(f, t, at(h, m)) for f in (1, 2, 3, 9) for t in (7, 100, 101) for h in (3, 4) for m in (0, 59)]
    spark.createDataFrame(files, "id bigint, anchor_id bigint").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame(tagged + tagged[:5], "file_id bigint, tag_id bigint, tagged_at timestamp_ntz").write.parquet(f"{tmp_path}/file_tags.parquet")
    want = Counter((dict(files)[f], f, t, when.replace(minute=0)) for f, t, when in tagged if f in dict(files))
    rows = catalogue.queries()["tag_arrivals"](spark, str(tmp_path)).collect()
    assert {(r.anchor_id, r.file_id, r.tag_id, r.hour): r.n for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("block", [7, 4_096])
def test_similar_texts_with_frequent_terms_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(tags, "BLOCK", block)
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abc'[i // 26]}" for i in rng.integers(0, 70, size=n))
    passage = text(15)
    right = [(i, passage) for i in range(25)] + [(100 + i, text(4 + i % 30)) for i in range(150)] + [(900, None), (901, "")]
    left = [(i, text(4 + 3 * i)) for i in range(20)] + [(50, passage), (51, passage + " zebra yonder"), (52, None), (53, "")]
    got = {(r.left_id, r.right_id): r.similarity for r in tags.similar_terms(spark.createDataFrame(left, "id bigint, text string"), spark.createDataFrame(right + right[:9], "id bigint, text string"), 0.2).collect()}
    sets = lambda rows: {i: set(t.split()) for i, t in rows if t}
    want = {(i, j): round(len(x & y) / len(x | y), 6) for i, x in sets(left).items() for j, y in sets(right).items()}
    assert got == {p: pytest.approx(s, abs=1e-6) for p, s in want.items() if s > 0.2} and {(50, i) for i in range(25)} <= set(got)


def test_ancestors_of_a_deep_tree_and_of_a_cycle(spark):
    deep = [(i, i - 1 if i else None) for i in range(70)]
    ring = [(500, 501), (501, 502), (502, 500), (503, 500), (600, 600)]
    got = sorted(tuple(r) for r in scopes.ancestors(spark.createDataFrame(deep + ring, "id bigint, parent_id bigint")).collect())
    want = [(i, j, i - j) for i in range(70) for j in range(i)]
    around = [(500, 501, 1), (500, 502, 2), (501, 502, 1), (501, 500, 2), (502, 500, 1), (502, 501, 2), (503, 500, 1), (503, 501, 2), (503, 502, 3)]
    assert got == sorted(want + around)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_and_samples_of_more_rows_than_the_range_sampler_takes(spark, adaptive):
    n = 1_200_000
    rows = spark.range(0, n, 1, 12).select((F.hash("id").cast("bigint") * 4 + F.col("id") % 4).alias("a"), F.col("id"))
    hot = rows.withColumn("a", F.when(F.col("id") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("a")))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        out = sync.numbered(hot.withColumnRenamed("id", "own"), ["a"], 5)
        got = out.select("id", "a").toArrow()
        at, value = got.column("id").to_numpy(), got.column("a").to_numpy()
        assert (np.sort(at) == np.arange(6, n + 6)).all() and (np.diff(value[np.argsort(at)]) >= 0).all()
        sample = search.systematic_sample(rows.select(F.col("a").alias("id")), 30)
        ids = np.unique(rows.select("a").toArrow().column("a").to_numpy()).tolist()
        step = len(ids) // 30
        assert sorted(r.id for r in sample.collect()) == ids[::step][:30]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_ties_send_no_more_than_k_rows_a_batch(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(i, [1.0, 2.0]) for i in range(50)]
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>")
    asked = spark.createDataFrame([(9, [2.0, 4.0])], "query_id bigint, vector array<double>")
    assert sorted(r.id for r in search.nearest_batch(frame, asked, 5).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.id for r in search.nearest(frame, [2.0, 4.0], 5).collect()) == [0, 1, 2, 3, 4]
