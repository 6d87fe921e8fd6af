"""Training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import os
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopegrain.llm import bpe, handwritten, leakage, neardup, quality, split, together, vectors
from scopegrain.llm.common import token_hashes
from scopegrain.shared import materialise

VECTORS = "id bigint, vector array<float>, b string"
CHUNKS = "id bigint, content string, vector array<float>, skey int"


def clouds(n, width=64, seed=3):
    """Vectors in loose groups, with copies, scaled copies and unusable ones."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, width))
    x = base[rng.integers(len(base), size=n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.2, 0.45], size=(n, 1))
    x[: n // 3] = x[0]
    return (x * rng.choice([1.0, 3.0], size=(n, 1))).astype(np.float32)


def test_most_similar_equals_brute_force_with_a_third_of_copies(spark):
    x, t = clouds(300), clouds(40, seed=4)
    bad = [(1000, None, ""), (1001, [0.0] * 64, ""), (1002, [float("inf")] * 64, ""), (1003, [1.0] * 3, ""), (None, x[0].tolist(), "")]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    chunks = spark.createDataFrame(rows + rows[:30] + bad, VECTORS)
    tags = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(t)] + bad, VECTORS)
    got = {(r.chunk_id, r.neighbour_kind, r.neighbour_id) for r in vectors.most_similar(chunks, tags).collect()}
    u, w = vectors.unit(x), vectors.unit(t)
    want = set()
    for i in range(len(u)):
        s = np.round(u @ u[i], 6)
        near = [j for j in range(len(u)) if j != i and s[j] >= 0.88]
        want |= {(i, "chunk", j) for j in sorted(near, key=lambda j: (-s[j], j))[:5]}
        s = np.round(w @ u[i], 6)
        want |= {(i, "tag", j) for j in sorted((j for j in range(len(w)) if s[j] >= 0.5), key=lambda j: (-s[j], j))[:3]}
    assert got == want


def test_vector_recall_with_many_cells(spark):
    x = clouds(9_000)[3_000:]
    frame = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], VECTORS)
    groups = materialise(vectors.vector_groups(vectors.usable_vectors(frame, "id", "vector"), 6), "recall")
    ids = {r.vkey: r.ids[0] for r in groups.select("vkey", "ids").collect()}
    got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in vectors.near_pairs(groups, 0.9).collect()}
    u = vectors.unit(x)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.round(u @ u.T, 6) >= 0.9, 1)), strict=True)}
    assert len(want) > 1000 and got <= want and len(got) >= 0.95 * len(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vectors.most_similar(none, none).count() == 0
    chunks = spark.createDataFrame([], CHUNKS)
    assert neardup.near_duplicates(chunks).count() == 0
    assert together.appear_together(spark.createDataFrame([], "grp bigint, basket bigint, item bigint")).count() == 0
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.leaked(docs, items).count() == 0 and quality.label_shares(docs).count() == 0 and bpe.encode_corpus(docs, "doc_id", "text").count() == 0


def test_baskets_equal_brute_force_in_any_blocking(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(b), int(i)) for g in range(3) for b in range(40) for i in set(rng.integers(0, 12, size=6)) | {0}]
    frame = spark.createDataFrame(rows + rows[:50] + [(None, 1, 1), (1, None, 1), (1, 1, None)], "grp bigint, basket bigint, item bigint")
    want = Counter()
    for g in range(3):
        for b in range(40):
            want.update((g, *p) for p in combinations(sorted({i for x, y, i in rows if (x, y) == (g, b)}), 2))
    got = {(r.grp, r.item_a, r.item_b): r.n_ab for r in together.appear_together(frame).collect()}
    assert got == dict(want)
    order = sorted(set(rows))
    columns = [np.array(c, np.int64) for c in zip(*order, strict=True)]
    for records, items in ((1, 2), (7, 5), (64, 1024)):
        seen = Counter()
        for part in together.gram_counts(*columns, records, items):
            for g, a, b, n in zip(*part, strict=True):
                seen[g, a, b] += n
        assert {k: v for k, v in seen.items() if k[1] != k[2]} == dict(want)


@pytest.mark.parametrize(("large", "dense", "step"), [(5, 600, 1 << 21), (8_192, 0, 7), (8_192, 1e9, 7)])
def test_large_baskets_and_both_products_give_the_same_counts(spark, monkeypatch, large, dense, step):
    for name, value in (("LARGE", large), ("DENSE", dense), ("STEP", step), ("ITEMS", 3), ("RECORDS", 9)):
        monkeypatch.setattr(together, name, value)
    rng = np.random.default_rng(8)
    rows = sorted({(g, b, int(i)) for g in range(2) for b in range(20) for i in rng.integers(0, 30, size=rng.choice([2, 4, 25]))})
    want = Counter()
    for g, b in {r[:2] for r in rows}:
        want.update((g, *p) for p in combinations([i for x, y, i in rows if (x, y) == (g, b)], 2))
    got = together.appear_together(spark.createDataFrame(rows + rows[:20], "grp bigint, basket bigint, item bigint")).collect()
    assert {(r.grp, r.item_a, r.item_b): r.n_ab for r in got} == dict(want)
    own = Counter((g, i) for g, _, i in rows)
    assert all(r.n_a == own[r.grp, r.item_a] and r.n_b == own[r.grp, r.item_b] and r.n == 20 for r in got)


def test_stored_edges_are_compared(spark):
    pairs = spark.createDataFrame([(1, 1, 2, 5), (1, 1, 3, 5), (1, 2, 3, 5)], "grp bigint, item_a bigint, item_b bigint, n_ab bigint")
    edges = spark.createDataFrame([(1, 2, 1, 3.0, 1), (1, 1, 2, 2.0, 2), (1, 1, 2, 2.0, 2), (1, 1, 3, None, 1), (1, None, 3, 5.0, 1)], "grp bigint, item_a bigint, item_b bigint, weight double, at int")
    got = {(r.item_a, r.item_b): r.verdict for r in together.compare_edges(pairs, edges).collect()}
    assert got == {(1, 2): "same", (1, 3): "differs", (2, 3): "absent"}


def words(n, seed, vocabulary=60):
    return [f"w{i}" for i in np.random.default_rng(seed).integers(0, vocabulary, size=n)]


def edited(base, edits, seed):
    rng, out = np.random.default_rng(seed), list(base)
    for _ in range(edits):
        out[rng.integers(len(out))] = f"new{rng.integers(1000)}"
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = {}
    for k in range(12):
        base = words(40 + 15 * k, k)
        for e in range(5):
            texts[len(texts)] = " ".join(edited(base, 2 * e, 100 * k + e))
    for _ in range(25):
        texts[len(texts)] = texts[0]
    texts |= {900: None, 901: "", 902: "too short", 903: " \n", 904: "long " * 5000}
    rows = [(i, t, None, 0) for i, t in texts.items()]
    got = {(r.chunk_a, r.chunk_b) for r in neardup.near_duplicates(spark.createDataFrame(rows + rows[:9], CHUNKS)).collect()}
    sets = {}
    for i, t in texts.items():
        w = re.findall("[a-z0-9_]+", (t or "").lower())
        if len(w) >= 30:
            sets[i] = set(zip(w, w[1:], w[2:], strict=False))
    want = {(i, j) for i, j in combinations(sorted(sets), 2) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert got == want


def test_long_lists_are_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = words(50, 1)
    rows = [(i, " ".join(edited(base, i % 9, i))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    members, pairs = neardup.near_duplicate_texts(frame, "doc_id", "text", 0.8, 5)
    named = {r.skey: r.id for r in members.groupBy("skey").agg(F.min("id").alias("id")).collect()}
    got = {tuple(sorted((named[r.a], named[r.b]))) for r in pairs.collect()}
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows if i in set(named.values())}
    assert got == {(i, j) for i, j in combinations(sorted(sets), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


@pytest.mark.parametrize("copies", [3, 2_048])
def test_pairs_of_large_classes_are_expanded_in_cells(spark, monkeypatch, copies):
    monkeypatch.setattr(neardup, "COPIES", copies)
    members = [(i, i % 3 if i < 24 else 9) for i in range(27)] + [(100, 50)]
    got = sorted(tuple(r) for r in neardup.expand(spark.createDataFrame([(0, 1), (2, 50)], "a bigint, b bigint"), spark.createDataFrame(members, "id bigint, key bigint")).collect())
    near = {(0, 1), (2, 50)}
    want = [(i, j) for (i, a), (j, b) in combinations(members, 2) if a == b or (min(a, b), max(a, b)) in near]
    assert got == sorted(want)


def test_token_hashes_follow_the_definition():
    texts = ["Aa_b aa-B 12", None, "", "ÉK xİy", "a" * 3000]
    found, owner = token_hashes(texts, underscore=True)
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall("[a-z0-9_]+", (t or "").lower())]
    assert owner.tolist() == [i for i, _ in want]
    assert len(set(zip(found.tolist(), (w for _, w in want), strict=True))) == len({w for _, w in want}) == len(set(found.tolist()))


def slow_pieces(x):
    out, s = [], 0
    starts = lambda e: e == 0 or x[e - 1] == "\n"
    blank = lambda e: starts(e) and e > 0 and not x[x.rfind("\n", 0, e - 1) + 1 : e - 1].strip(" \t\r")
    kinds = (lambda e: starts(e) and re.match("#{1,6} ", x[e : e + 8]), blank, starts, lambda e: x[e - 1] in " \t", lambda e: e == s + 512)
    while len(x) - s > 512:
        e = next(m for m in (max((e for e in range(s + 256, s + 513) if k(e)), default=0) for k in kinds) if m)
        out.append((s, e))
        s = e - 64
    return [*out, (s, len(x))]


@pytest.mark.parametrize("seed", range(6))
def test_pieces_equal_a_plain_reading(seed):
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(["word ", "x" * 40, "\n", "\n \t\r\n", "\n## Head\n", "\n####### no\n", "字"], p=[0.5, 0.1, 0.15, 0.05, 0.03, 0.02, 0.15], size=1200))
    assert split.pieces(text) == slow_pieces(text)


def test_sentences_may_be_a_level_of_the_hierarchy():
    text = "One short sentence here. " * 40
    with_ = split.pieces(text, hierarchy=("heading", "paragraph", "line", "sentence", "word"))
    assert all(text[:e].endswith(". ") for _, e in with_[:-1]) and len(with_) > 1
    assert split.pieces("字。" * 400, 512, 256, 64, ("sentence",))[0] == (0, 512)


def test_split_rows(spark):
    rows = [(1, "a" * 1200, None, "h"), (1, "a" * 1200, None, "h"), (2, None, 1, None), (3, "", 1, None), (4, "b\n" * 400, 7, ""), (None, "a" * 600, 1, None), (5, "a" * 512, 1, None)]
    got = split.split_oversized(spark.createDataFrame(rows, "id bigint, content string, start_line int, heading string")).orderBy("chunk_id", "piece_no").collect()
    assert [(r.chunk_id, r.char_start, r.char_end, r.line_start) for r in got if r.chunk_id == 1] == [(1, 0, 512, 1), (1, 448, 960, 1), (1, 896, 1200, 1)]
    assert {r.chunk_id for r in got} == {1, 4} and max(r.line_end for r in got if r.chunk_id == 4) == 406


def test_encoding_equals_the_public_library(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    texts = ["Hello  world's\n\n don't", "aaaaaaaaaaa" * 50, "", None, "<|endoftext|>", "日本語テキスト 🏳️‍🌈", " \t\r\n  x", "é" * 9, "0123456789" * 30, "ab" * 7 + "a"]
    got = {r.d: r.ids for r in bpe.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "d int, t string"), "d", "t").collect()}
    assert got == {i: public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_leaks_equal_brute_force(spark):
    items = {i: " ".join(words(20 + i, i, 500)) for i in range(8)} | {20: None, 21: "", 22: "only a few words", 23: "a b " * 10}
    docs = {}
    for k in range(40):
        w = words(60, 100 + k, 500)
        part = items[k % 8].split()
        cut = part[k % 5 : k % 5 + 9 + k % 6]
        docs[k] = " ".join(w[:30] + cut + w[30:]).upper().replace(" ", "  -- ")
    docs |= {90: None, 91: "", 92: " ".join(words(3000, 9, 500)) + " " + items[3], 93: "b a " * 9}
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(spark.createDataFrame(list(docs.items()) + [(5, docs[5])], "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()}
    grams = lambda t: {tuple(w[i : i + 12]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for i in range(len(w) - 11)}
    assert got == {(d, i) for d, t in docs.items() for i, s in items.items() if grams(t) & grams(s)} and got


PROSE = "The search returns the short answers first, and then it looks at the rest of them. "
OTHERS = ["- pack shard\n- narrow ledger.\n- blend token\n" * 8, "".join(f"{i};vudo{i};mesh;0.{i}5\n" for i in range(10, 40)), "Loading…\n" * 30, "*****\n-------\n=====\n" * 9, "".join(f"2025-01-0{i % 9 + 1}T10:00Z INFO bupo[{i}] sync patch ok=1\n" for i in range(30)), "k e l o p a n i " * 20]
KEPT = [PROSE * 5, PROSE, "# Title\n\n" + PROSE * 4 + "\n\n- one item\n- two items\n\n" + PROSE * 3, "Der Index wird jede Nacht neu gebaut, damit die Suche schnell bleibt. " * 4, "每个文件会先检查上一次的摘要，所以结果比较稳定。" * 5, PROSE.lower().replace(",", "").replace(".", "") * 5]


def test_line_labels_separate_prose(spark):
    rows = list(enumerate(KEPT * 10)) + [(1000 + i, t) for i, t in enumerate(OTHERS * 3)] + [(5000, None), (5001, ""), (5002, " \n\t")]
    shares = {r.doc_id: r for r in quality.label_shares(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(shares[i].prose >= quality.PROSE_LEAST for i in range(len(KEPT) * 10))
    assert all(shares[1000 + i].prose < quality.PROSE_LEAST for i in range(len(OTHERS) * 3))
    assert all(shares[i].units == 0 and shares[i].prose is None for i in (5000, 5001, 5002))


def test_the_chain_decides_doubtful_lines(spark):
    doubtful = "Alpha beta gamma"
    prose = (PROSE.strip() + "\n") * 1
    inside = [f"{PROSE}\nIn the end it is for them, and we see what of it was there at {i}.\n{doubtful}\nThere was a reason for it, which is what you asked about {i}." for i in range(60)]
    lists = ["\n".join([f"- {w} {v}" for w, v in zip("abcdefgh", "stuvwxyz")] + [doubtful] + [f"- {v} {w} item" for w, v in zip("abcdefgh", "stuvwxyz")]) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(inside + lists + [prose, "x", "\u2028.", None])), "doc_id bigint, text string")
    lines = quality.observations(frame, "doc_id", "text")
    model = quality.fit(lines)
    parts = [quality._read(b) for b in lines.orderBy("doc_id").toArrow().to_batches()]
    observed, lengths = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    path, alone = quality.best_path(model, observed, lengths), quality.likelihoods(model, observed).argmax(axis=1)
    assert (path != alone).any()
    shown = {r.doc_id: r.labels for r in quality.label_shares(frame).collect()}
    assert set(shown[0]) == {"p"} and set(shown[60]) == {"l"} and shown[123] == "" and len(shown[0]) == lengths[0]


def test_batched_path_and_posterior_equal_single_documents():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 7, 1, 12])
    observed = np.stack([rng.integers(0, k, size=lengths.sum()) for k in quality.SIZES.values()], axis=1)
    model = quality.model_of(rng.uniform(0, 9, size=20 + 4 * int(quality.EDGES[-1])))
    path, (gamma, _) = quality.best_path(model, observed, lengths), quality.posterior(model, observed, lengths)
    ends = np.cumsum(lengths)
    ll = quality.likelihoods(model, observed)
    for begin, end in zip(ends - lengths, ends, strict=True):
        own, n = ll[begin:end], end - begin
        every = np.array(np.meshgrid(*[range(4)] * n, indexing="ij")).reshape(n, -1).T if 0 < n <= 7 else None
        if every is None:
            continue
        score = model.start[every[:, 0]] + own[np.arange(n), every].sum(axis=1) + model.move[every[:, :-1], every[:, 1:]].sum(axis=1)
        assert path[begin:end].tolist() == every[score.argmax()].tolist()
        weight = np.exp(score - score.max())
        want = np.array([[weight[every[:, i] == s].sum() for s in range(4)] for i in range(n)]) / weight.sum()
        assert np.allclose(gamma[begin:end], want)


def test_text_statistics(spark):
    frame = spark.createDataFrame([(1, "The cat sat.\nno end\n\n!!"), (2, None), (3, ""), (4, "the end")], "doc_id bigint, text string")
    row = {r.doc_id: r for r in quality.text_statistics(frame).collect()}
    assert row[1].words == 5 and row[1].end_punctuation_share == pytest.approx(2 / 3, abs=1e-6) and row[1].common_word_share == 1.0
    assert row[2].words == row[3].words == 0 and row[2].mean_word_length is None
    assert quality.frequent_words(frame, most=2) == ["end", "the"]


def test_giveaways_and_features():
    assert handwritten.giveaway("// Code generated by x. DO NOT EDIT\nfoo()") and handwritten.giveaway("# lib v1.2.3\n# Copyright\nx=1")
    assert not handwritten.giveaway("// DO NOT EDIT the order below\nfoo()") and not handwritten.giveaway("x = 1\n# @generated by y")
    far = "// line\n" * 40 + "/* block\n" + "words " * 200 + "\nCode generated by x\n*/\n"
    assert handwritten.giveaway(far + "foo()") and handwritten.leading(far + "foo()")[1] == "foo()"
    assert handwritten.giveaway('"""Notes.\n\nMachine output of y\n"""\nimport z') and handwritten.leading("#include <x>")[0] == "" and handwritten.leading("") == ("", "")
    assert "p:^/vendor" in handwritten.path_features(".\\r\\s/vendor/x-1.2/y.min.js", "r/s") and "f:min" in handwritten.path_features("y.min.js")
    assert handwritten.leading("/*! x 1.2 */var a=1;")[1] == "var a=1;"


def test_svm_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([i % 2, 2 + i % 5]), np.array([1.0, rng.normal()])) for i in range(60)]
    labels = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    weights, bias = handwritten.train_svm(rows, labels, 8, cost=1.0)
    assert all(np.sign(weights[a] @ v + bias) == y for (a, v), y in zip(rows, labels, strict=True))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_classifier_on_held_out_repositories(spark):
    report = {r.figure: r.value for r in handwritten.p4_validation(spark, "/root/testdata/sf0.1").collect()}
    assert report["specificity"] > 0.94 and report["recall"] > 0.9 and report["recall_masked"] > 0.7


def test_classifier_on_small_and_odd_tables(spark):
    rng = np.random.default_rng(4)
    code = lambda: "\n".join(f"def {''.join(rng.choice(list('abcdefgh'), 6))}(x):\n    return x" for _ in range(8))
    files, chunks = [], []
    for i in range(80):
        made = i % 4 == 0
        files.append((i, i % 8, f"r{i % 8}/{'gen' if made else 'src'}/f{i}.py", "x"))
        text = "# Code generated by tool. DO NOT EDIT.\n" + "a = 1;b = 2;\n" * 20 if made else code()
        chunks += [(2 * i, i, 0, text, "y"), (2 * i + 1, i, 1, code() if not made else "a = 3;\n" * 9, "y")]
    files += [(200, None, None, "x"), (None, 1, "a.py", "x"), (201, 3, "r3/src/none.py", "x")]
    chunks += [(900, 200, 0, None, "y"), (901, 999, 0, "x", "y"), (None, 1, 0, "x", "y"), (902, 201, None, "", "y")]
    f = spark.createDataFrame(files + files[:5], "id bigint, anchor_id bigint, path string, score string")
    c = spark.createDataFrame(chunks + chunks[:9], "id bigint, file_id bigint, chunk_index int, content string, marked string")
    r = spark.createDataFrame([(i, f"r{i}") for i in range(8)], "id bigint, path string")
    got = handwritten.not_handwritten(f, c, r).collect()
    assert sorted(x.file_id for x in got) == [*range(80), 200, 201]
    assert {x.file_id for x in got if x.found} == set(range(0, 80, 4))
    assert handwritten.not_handwritten(f.limit(0), c.limit(0), r.limit(0)).count() == 0
