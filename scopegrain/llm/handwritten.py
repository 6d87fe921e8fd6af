"""Generated, minified or vendored source files, by a linear support-vector classifier.

Features are hashed character n-grams of a file's whole content (raw, and of its shape, where runs of letters, digits and
white space count as one character), n-grams of its leading comment apart, and the components of its path. The labels to learn
from come from giveaways: leading comments that tools and copies of other projects carry, and files most of whose lines only
data or minifiers have. All others are unlabelled: mostly hand-written, but with the files among them that carry no giveaway.
So the fit is one from positive and unlabelled files: errors on either side weigh such that a file counts as a case where at
least ``SHARE`` of its like carry a giveaway, and unlabelled files that the first fit puts among the cases are left out of the
second.

Every labelled file is learned from twice, as it is and with its leading comment masked, so that the classifier must find other
evidence and can judge files that lost theirs. Validation splits by repository, so that no project's names are on both sides;
scales, path features and weights come from the training repositories only.

A file's score is a sum over its chunks of linear terms, so chunks are scored where they lie and only sums are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopegrain.llm.common import mix64, slices
from scopegrain.shared import materialise

#: Files of each label that the classifier is fitted to at most, hashed features of each kind, and one in how many
#: repositories is held out of a validation.
SAMPLE, RAW, SHAPE, HEADS, PATHS, HELD_OUT = 1_500, 1 << 15, 1 << 15, 1 << 14, 1 << 18, 5
#: Repositories of the sample that must hold a path feature for it to count.
REPOSITORIES = 3
#: Value of a path feature, beside n-gram shares that are scaled to a mean of about 1.
PATH = 1.5
#: Share of giveaways among like files from which on a file counts as a case.
SHARE = 0.22
#: Where the features of leading comments and of paths begin, and how many features there are.
HEAD_AT, PATH_AT, ALL = RAW + SHAPE, RAW + SHAPE + HEADS, RAW + SHAPE + HEADS + PATHS

#: Fixed patterns: leading comments of generated files and of copies of other projects.
GENERATED = re.compile(r"@generated\b|<auto-?generated|\bcode generated by\b|auto-?generated file|\bmachine output of\b|\bfile was (?:written|generated|created) by\b|\bgenerated by \S+.*do not (?:edit|modify)|automatisch (?:erzeugt|generiert)|自动生成|自動生成", re.IGNORECASE)
COPIED = re.compile(r"\bvendored from\b|\bbundled copy of\b|\bimported unchanged\b|\btaken from upstream\b|\(c\) \d{4}.*\bcontributors\b|\bcopyright\b.*\bauthors\b|^\W*[\w.\-]+ v\d+\.\d+\.\d+\W*$|^\s*/\*!\s*\S+ v?\d+\.\d+", re.IGNORECASE)
#: Line and block comments of the usual languages, and strings that stand before the code.
LEADING = re.compile(r"(?:[\s\ufeff]++|//[^\n]*+|#(?![ ]?(?:include|define|if|pragma))[^\n]*+|--[^\n]*+|;[^\n]*+|%[^\n]*+|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z))*+", re.DOTALL)
ENCODED = re.compile(r"[A-Za-z0-9+/=]{40,}")
PROSE = ("md", "mdx", "markdown", "rst", "txt", "adoc")


def leading(text: str) -> tuple[str, str]:
    """The whole leading comment of a file, and its text without it."""
    end = LEADING.match(text).end()
    return text[:end], text[end:]


def giveaway(text: str) -> bool:
    return any(GENERATED.search(x) or COPIED.search(x) for x in leading(text)[0].split("\n"))


def odd_lines(text: str) -> tuple[int, int]:
    """Characters in lines of data and in lines that only a minifier writes."""
    data = dense = 0
    for line in text.split("\n"):
        n = len(line)
        if n < 40:
            continue
        digits = sum(map(line.count, "0123456789"))
        coded = sum(len(m) for m in ENCODED.findall(line) if any(c.isdigit() for c in m) and any(c.isupper() for c in m))
        if digits > 0.3 * n or coded > 0.6 * n:
            data += n
        elif n >= 160 and line.count(" ") < 0.05 * n and line.isascii():
            dense += n
    return data, dense


def path_features(path: str, root: str | None = None) -> list[str]:
    """The components of a path below ``root``; the file's own stem counts by its endings, versions and hashes by their form."""
    parts = [x for x in path.replace("\\", "/").split("/") if x not in ("", ".")]
    above = [x for x in (root or "").replace("\\", "/").split("/") if x not in ("", ".")]
    if above and [x.lower() for x in parts[: len(above)]] == [x.lower() for x in above]:
        parts = ["^", *parts[len(above) :]]
    named = [re.sub(r"^\d+(\.\d+)+$", "<version>", re.sub(r"-\d+(\.\d+)+$", "-<version>", x.lower())) for x in parts[:-1]]
    form = ["<any>-<version>" if x.endswith("-<version>") else x for x in named]
    name = parts[-1].lower() if parts else ""
    tail = ["<hash>" if re.fullmatch(r"[0-9a-f]{8,}", x) else x for x in re.split(r"[._\-]", name)[1:]]
    out = [f"d:{x}" for x in form] + [f"p:{a}/{b}" for a, b in zip(form, form[1:], strict=False)] + [f"f:{x}" for x in tail]
    return sorted({*out, f"s:{'.'.join(tail[-2:])}"})


def path_index(features: list[str]) -> np.ndarray:
    data = [np.frombuffer(f.encode(), np.uint8).astype(np.uint64) for f in features]
    keys = [int(mix64((mix64(d + np.arange(len(d), dtype=np.uint64) * np.uint64(257)).sum(dtype=np.uint64) + np.uint64(len(d))).reshape(1))[0]) for d in data]
    return np.array([PATH_AT + k % PATHS for k in keys], np.int64)


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[[9, 10, 11, 12, 13]] = 10
    table[128:] = 200
    return table


def content_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram of the texts: raw 4-grams in lower case, and 6-grams of the shape."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    out = []
    upper = (data >= 65) & (data <= 90)
    shape = _classes()[data]
    run = np.zeros(len(data), bool)
    if len(data):
        run[1:] = (shape[1:] == shape[:-1]) & (owner[1:] == owner[:-1]) & np.isin(shape[1:], np.array([ord("a"), ord("A"), ord("0"), ord(" "), 10, 200], np.uint64))
    for codes, of, n, size, base in (((data + upper * 32).astype(np.uint64), owner, 4, RAW, 0), (shape[~run], owner[~run], 6, SHAPE, RAW)):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint64)
        for i in range(n):
            key = key * np.uint64(257) + codes[i : i + m]
        whole = of[:m] == of[n - 1 :]
        out.append((of[:m][whole], (mix64(key[whole]) % np.uint64(size)).astype(np.int64) + base))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def head_features(heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every raw 4-gram of leading comments."""
    owner, feature = content_features(heads)
    raw = feature < RAW
    return owner[raw], HEAD_AT + feature[raw] % HEADS


@dataclass(frozen=True)
class Classifier:
    """Weights of all hashed features, already divided by their scales; and the intercept."""

    weights: np.ndarray
    bias: float


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, cost: np.ndarray | float = 0.02, rounds: int = 30, enough: float = 0.05) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by dual coordinate descent; the rows are (features, values), the bias a feature of 1.

    ``cost`` may differ by row. Rows at their bound rest for a round; it ends when no row moves its gradient by ``enough``.
    """
    weights, bias = np.zeros(size, np.float64), 0.0
    alpha, diag = np.zeros(len(rows)), 0.5 / np.broadcast_to(cost, len(rows))
    norms = np.array([(v * v).sum() + 1 for _, v in rows]) + diag
    rng = np.random.default_rng(5)
    rest = np.zeros(len(rows), bool)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            if rest[i]:
                rest[i] = False
                continue
            at, value = rows[i]
            gradient = labels[i] * (weights[at] @ value + bias) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norms[i])
            if new != alpha[i]:
                worst = max(worst, abs(gradient))
                move = (new - alpha[i]) * labels[i]
                weights[at] += move * value
                bias += move
                alpha[i] = new
            elif gradient > 0:
                rest[i] = True
        if worst < enough:
            break
    return weights, bias


def _chunk_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = batch.column(2).to_pylist()
        texts = batch.column(3).to_pylist()
        marks = [bool(t and i == 0 and giveaway(t)) for i, t in zip(first, texts, strict=True)]
        odd = [odd_lines(t) if t else (0, 0) for t in texts]
        size = [len(t) if t else 0 for t in texts]
        columns = [pa.array(marks), pa.array([o[0] for o in odd], pa.int64()), pa.array([o[1] for o in odd], pa.int64()), pa.array(size, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "file_id", "mark", "data", "dense", "size"])


def giveaways(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, path, root, repo, marked, odd): whether a file's head gives it away, and whether most of it is data or minified."""
    seen = chunks.mapInArrow(_chunk_labels, "id bigint, file_id bigint, mark boolean, data bigint, dense bigint, size bigint").dropDuplicates(["id"])
    each = seen.groupBy("file_id").agg(F.max("mark").alias("mark"), F.sum("data").alias("data"), F.sum("dense").alias("dense"), F.sum("size").alias("size"))
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    joined = files.join(each, "file_id", "left").withColumn("code", ~suffix.isin(*PROSE))
    odd = F.coalesce(F.col("code") & ((F.col("data") > 0.5 * F.col("size")) | (F.col("dense") > 0.5 * F.col("size"))), F.lit(False))
    return joined.select("file_id", "path", "root", "repo", F.coalesce(F.col("mark") & F.col("code"), F.lit(False)).alias("marked"), odd.alias("odd"))


def _parts(first: list[int | None], texts: list[str | None]) -> tuple[list[str], list[str]]:
    """Leading comments (of first chunks) and bodies."""
    both = [(leading(t) if i == 0 else ("", t)) if t else ("", "") for i, t in zip(first, texts, strict=True)]
    return [h for h, _ in both], [b for _, b in both]


def _counted(owner: np.ndarray, feature: np.ndarray, n: int) -> list[bytes]:
    """(feature, count) pairs of each text as bytes."""
    key, count = np.unique(owner * PATH_AT + feature, return_counts=True)
    edges = np.searchsorted(key // PATH_AT, np.arange(n + 1))
    flat = np.stack([key % PATH_AT, count], axis=1).astype(np.int32)
    return [flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads, bodies = _parts(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        for begin, end in slices(bodies, 1 << 20):
            columns = [pa.array(_counted(*features(texts[begin:end]), end - begin), pa.binary()) for features, texts in ((content_features, bodies), (head_features, heads))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), *columns], ["id", "file_id", "body", "head"])


def _chunk_scores(weights: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, bodies = _parts(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for begin, end in slices(bodies, 1 << 20):
                sums = []
                for owner, feature in (content_features(bodies[begin:end]), head_features(heads[begin:end])):
                    sums.append((np.bincount(owner, weights=weights[feature], minlength=end - begin), np.bincount(owner, minlength=end - begin)))
                (total, n), (head, m) = sums
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), pa.array(total), pa.array(n.astype(np.int64)), pa.array(head / np.maximum(1, m))], ["id", "file_id", "total", "n", "head"])

    return run


@dataclass(frozen=True)
class Sample:
    """Labelled files: (file_id, path, root, repo, marked, odd), their n-gram shares, and how many files each label has in all."""

    rows: list
    counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    totals: tuple[int, int]


def _merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(parts) if parts else np.empty((0, 2), np.int32)
    key, inverse = np.unique(flat[:, 0], return_inverse=True)
    count = np.bincount(inverse, weights=flat[:, 1], minlength=len(key))
    return key.astype(np.int32), (count / max(1.0, count.sum())).astype(np.float32)


def labelled_sample(labels: DataFrame, chunks: DataFrame) -> Sample:
    """At most ``SAMPLE`` files with and without giveaways, chosen by hash, and the n-gram shares of each."""
    order = F.xxhash64("file_id", F.lit("sample"))
    with_ = F.col("marked") | F.col("odd")
    rows = [r for side in (with_, ~with_) for r in labels.filter(side).orderBy(order, "file_id").limit(SAMPLE).collect()]
    size = labels.agg(F.count_if(with_).alias("p"), F.count_if(~with_).alias("u")).first()
    wanted = labels.sparkSession.createDataFrame([(r.file_id,) for r in rows], "file_id bigint")
    counted = chunks.join(F.broadcast(wanted), "file_id").select(*chunks.columns).mapInArrow(_chunk_counts, "id bigint, file_id bigint, body binary, head binary").toArrow()
    seen: set[int] = set()
    held: dict[int, tuple[list, list]] = {}
    for batch in counted.to_batches():
        for one, file, *raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if one not in seen:
                seen.add(one)
                for side, part in zip(held.setdefault(file, ([], [])), raw, strict=True):
                    side.append(np.frombuffer(part.as_buffer(), np.int32).reshape(-1, 2))
    counts = {}
    for file in list(held):
        body, head = held.pop(file)
        counts[file] = (*_merged(body), *_merged(head))
    return Sample(rows, counts, (size.p, size.u))


def _aside(repo: int | None) -> bool:
    return repo is not None and int(mix64(np.array([repo], np.int64).view(np.uint64))[0]) % HELD_OUT == 0


def fit(sample: Sample, held_out: bool = False) -> tuple[Classifier, dict[str, float]]:
    """The classifier of a labelled sample; with ``held_out``, fitted without the repositories kept aside, and its figures there.

    ``recall_masked`` is over the held-out files with giveaways when their leading comments are masked; those whose giveaway is
    the leading comment alone can be told by nothing else but their path and content. ``recall`` and ``specificity`` are over
    the files as they are.
    """
    none = (np.empty(0, np.int32), np.empty(0, np.float32)) * 2
    use = [r for r in sample.rows if not (held_out and _aside(r.repo))]
    aside = [r for r in sample.rows if held_out and _aside(r.repo)]
    homes: dict[str, set] = {}
    for r in use:
        for f in path_features(r.path or "", r.root):
            homes.setdefault(f, set()).add(r.repo)
    least = min(REPOSITORIES, len({r.repo for r in use}))
    mean = np.zeros(ALL)
    for r in use:
        at, n, head_at, m = sample.counts.get(r.file_id, none)
        mean[at] += n / len(use)
        mean[head_at] += m / len(use)
    scale = 2 / np.sqrt(mean + 1e-4)
    scale[PATH_AT:] = PATH

    def row(r, masked: bool) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        at, n, head_at, m = sample.counts.get(r.file_id, none)
        path = path_index([f for f in path_features(r.path or "", r.root) if len(homes.get(f, ())) >= least]).astype(np.int32)
        parts = [(at, n * scale[at]), (path, np.full(len(path), PATH)), *([] if masked else [(head_at, m * scale[head_at])])]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.float32)

    views = [(r, masked) for r in use for masked in ((True, False) if len(sample.counts.get(r.file_id, none)[2]) else (True,))]
    data = [row(*v) for v in views]
    labels = np.array([1.0 if r.marked or r.odd else -1.0 for r, _ in views])
    taken = [sum(r.marked or r.odd for r in sample.rows), sum(not (r.marked or r.odd) for r in sample.rows)]
    rate = [t / max(1, n) for t, n in zip(taken, sample.totals, strict=True)]
    favour = (1 - SHARE) / SHARE * (rate[1] / rate[0]) if all(rate) else 1.0
    cost = 0.02 * np.where(labels > 0, favour, 1.0) / favour**0.5
    # By their paths alone first: unlabelled files that lie where giveaways are common cannot stand in as hand-written.
    lone = [(at[at >= PATH_AT], v[at >= PATH_AT]) for at, v in data]
    weights, bias = np.zeros(ALL), 0.0
    keep = np.arange(len(data))
    for part, price in ((lone, 20.0), (data, 1.0), (data, 1.0)):
        if len(keep):
            weights, bias = train_svm([part[i] for i in keep], labels[keep], ALL, cost[keep] * price)
        margin = np.array([weights[at] @ v + bias for at, v in part])
        keep = keep[(labels[keep] > 0) | (margin[keep] <= 0)]
    report = {}
    if aside:
        truth = np.array([r.marked or r.odd for r in aside], bool)
        whole, masked = (np.array([weights[at] @ v + bias > 0 for at, v in (row(r, m) for r in aside)]) for m in (False, True))
        share = lambda hit, of: float(hit[of].mean()) if of.any() else float("nan")
        report = {"files": len(aside), "accuracy": float((whole == truth).mean()), "recall": share(whole, truth), "recall_masked": share(masked, truth), "specificity": share(~whole, ~truth)}
    return Classifier((weights * scale).astype(np.float64), bias), report


def sources(files: DataFrame, chunks: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The giveaways of every file, as a written table, and the chunks' columns that are read."""
    own = files.select(F.col("id").cast("bigint").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("anchor_id").cast("bigint").alias("repo")).filter("file_id is not null")
    own = own.groupBy("file_id").agg(F.max("path").alias("path"), F.max("repo").alias("repo"))
    named = roots.groupBy(F.col("id").cast("bigint").alias("repo")).agg(F.max("path").alias("root"))
    own = own.join(named, "repo", "left").select("file_id", "path", "root", "repo")
    parts = chunks.select(F.col("id").cast("bigint").alias("id"), F.col("file_id").cast("bigint").alias("file_id"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("content").cast("string").alias("content")).filter("id is not null and file_id is not null")
    return materialise(giveaways(own, parts), "giveaways"), parts


def not_handwritten(files: DataFrame, chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """(file_id, score, marked, odd, found): each file's margin, giveaways, and whether it is a case: a margin above 0.

    ``files`` has id, anchor_id and path, ``chunks`` id, file_id, chunk_index and content, ``roots`` id and path of the
    repositories; other columns are ignored. Giveaways serve the fit only. Repeated rows count once. A null path or content
    adds nothing; a file without chunks is judged by its path alone; chunks of unknown files and null ids drop out. Empty
    tables give no rows.
    """
    labels, parts = sources(files, chunks, roots)
    model, _ = fit(labelled_sample(labels, parts))
    weights, bias = model.weights, model.bias
    scored = parts.mapInArrow(_chunk_scores(weights[:PATH_AT]), "id bigint, file_id bigint, total double, n bigint, head double").dropDuplicates(["id"])
    sums = scored.groupBy("file_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("head").alias("head"))

    def by_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [float(weights[path_index(path_features(p, r))].sum()) if p else 0.0 for p, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], ["file_id", "by_path"])

    paths = labels.select("file_id", "path", "root").mapInArrow(by_path, "file_id bigint, by_path double")
    score = F.coalesce(F.col("total") / F.nullif("n", F.lit(0)), F.lit(0.0)) + F.coalesce("head", F.lit(0.0)) + F.col("by_path") + F.lit(float(bias))
    joined = labels.select("file_id", "marked", "odd").join(paths, "file_id").join(sums, "file_id", "left").withColumn("score", score)
    return joined.select("file_id", "score", "marked", "odd", (F.col("score") > 0).alias("found"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, chunks, roots = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("files", "chunks", "anchors"))
    return not_handwritten(files, chunks, roots).filter("found").select("file_id")


def p4_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(figure, value): how a classifier fitted without the held-out repositories judges those."""
    files, chunks, roots = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("files", "chunks", "anchors"))
    report = fit(labelled_sample(*sources(files, chunks, roots)), held_out=True)[1]
    return spark.createDataFrame([(k, float(v)) for k, v in report.items()], "figure string, value double")
