"""Training-data queries that must lose nothing where records are close, against brute force on fixtures."""

import re
from itertools import combinations

import numpy as np
import pytest

from scopegrain.llm import neardup, vectors

VECTORS = "id bigint, vector array<float>"


def test_most_similar_in_tight_clusters_and_among_scaled_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HELD", 1_000)
    rng = np.random.default_rng(11)
    tight = rng.normal(size=64) + rng.normal(size=(300, 64)) * 0.02
    scaled = rng.normal(size=(1, 64)) * rng.uniform(0.1, 9.0, size=(300, 1))
    x = np.concatenate([tight, scaled])[rng.permutation(600)].astype(np.float32)
    got = {(r.chunk_id, r.neighbour_id) for r in vectors.most_similar(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)).collect()}
    u = vectors.unit(x)
    want = set()
    for i in range(len(u)):
        s = np.round(u @ u[i], 6)
        want |= {(i, j) for j in sorted((j for j in range(len(u)) if j != i and s[j] >= 0.88), key=lambda j: (-s[j], j))[:5]}
    assert got == want


def test_every_document_has_a_class_and_similar_classes_are_paired(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 60, size=60)]
    texts = {k: " ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(0, 60, 7)}
    texts |= {101: texts[0], 102: texts[0].upper(), 103: " ".join(f"v{i}" for i in range(30))}
    texts |= {200: "每个文件会先检查上一次的摘要", 201: "每个文件会先检查上一次的摘要", 202: "所以结果比较稳定", 203: "only four tokens here", 204: "", 205: "", 206: None, 207: None}
    rows = list(texts.items())
    spark.createDataFrame(rows + rows[:4] + rows[-4:] + [(None, "x")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {}
    for i, t in texts.items():
        w = re.findall("[a-z0-9_]+", (t or "").lower())
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) or (t if t is not None else i)
    first = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    heads = sorted(i for i in set(first.values()) if isinstance(sets[i], frozenset))
    pairs = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in combinations(heads, 2)}
    pairs = {p: pytest.approx(s, abs=1e-6) for p, s in pairs.items() if s >= 0.8}
    classes = neardup.p3_classes(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.class_id, r.members, r.links) for r in classes) == [(i, c, list(first.values()).count(c), sum(c in p for p in pairs)) for i, c in sorted(first.items())]
    got = neardup.p3_pairs(spark, str(tmp_path)).collect()
    assert {(r.class_a, r.class_b): r.similarity for r in got} == pairs and len(got) == len(pairs) > 0
