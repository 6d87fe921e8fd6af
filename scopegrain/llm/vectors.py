"""Most similar vectors for every vector: additive quantisation, then exact reranking.

A vector is written as a sum of full-dimensional codewords. The first two codebooks name the cell that holds the vector;
the others refine it. Beam search picks the codewords. A query looks up the inner products with all codewords once and
scores every vector of the cells it probes by table look-ups, divided by a stored norm. What survives the score's error
margin is scored again from the vectors themselves, in double precision. In a search for the k best that happens on the
spot, and each vector's k best of a block leave it; else one byte an element drops most pairs before the vectors are joined.

Equal vectors are one row of the index, so that a group of copies of any size costs no more than one vector. A cell beyond
``BLOCK`` vectors is cut into blocks. Nothing that grows with the data is collected or broadcast: codebooks are fitted on at
most ``SAMPLE`` vectors, and only the sizes of cells beyond half of ``BLOCK``
come to the driver (no more than the vectors over 4,096).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import floor, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopegrain.llm.common import decode_vectors, fixed_binary, from_binary, mix64
from scopegrain.shared import materialise

#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 16_384
#: Codewords of a refining codebook, refining codebooks, paths kept by the beam search, cells a query probes.
WORDS, LEVELS, BEAM, PROBES = 64, 6, 4, 8
#: Bits of the largest of the two codebooks that name cells, so that 2^24 cells of ``CELL`` vectors are 4 billion vectors.
COARSE = 12
#: Mean number of vectors that a cell should hold, and the most that one task holds at once.
CELL, BLOCK = 256, 8_192
#: Standard deviations of the score's error that a candidate may lie under the threshold.
MARGIN = 4.0
#: Passes over the cells in a search for the k best, each with its shuffle files dropped, since whole vectors are sent there.
PASSES = 3
#: Candidates that a block's vectors hold, from all that asked, before they are cut to each vector's k best.
HELD = 200_000
#: Rows of the other side that are scored in one pass, exactly.
SIDE = 4_096


@dataclass(frozen=True)
class Codebooks:
    """Codewords by level; the first two levels address the cells."""

    levels: list[np.ndarray]
    width: int

    @property
    def cells(self) -> int:
        return len(self.levels[0]) * len(self.levels[1])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def k_means(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; an emptied centre moves to a random row."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (rows @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        count = np.bincount(nearest, minlength=len(centres))
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])
        held = count > 0
        centres[held] = np.add.reduceat(rows[order], starts[held], axis=0) / count[held][:, None]
        centres[~held] = rows[rng.integers(len(rows), size=int((~held).sum()))]
    return centres


def fit_codebooks(sample: np.ndarray, total: int) -> Codebooks:
    """Residual codebooks from unit vectors; the number of cells follows ``total``, the size of the collection."""
    width = sample.shape[1]
    coarse = 1 << max(0, min(COARSE, floor(log2(max(1.0, sqrt(total / CELL))))))
    rest, levels = sample.astype(np.float32), []
    for level in range(2 + LEVELS):
        words = k_means(rest, coarse if level < 2 else WORDS, seed=level)
        levels.append(words.astype(np.float32))
        rest = rest - words[(rest @ words.T - 0.5 * (words * words).sum(axis=1)).argmax(axis=1)]
    return Codebooks(levels, width)


def widen(rest: np.ndarray, score: np.ndarray, words: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One level of the beam search: residuals (rows, paths, width) and scores by path give the ``keep`` best longer paths.

    Returns the path each came from, its new codeword, its score (half the squared distance, negated) and its residual.
    """
    n, paths, width = rest.shape
    gain = (rest.reshape(-1, width) @ words.T - 0.5 * (words * words).sum(axis=1)).reshape(n, paths, len(words))
    flat = (gain + score[:, :, None]).reshape(n, -1)
    keep = min(keep, flat.shape[1])
    best = np.argpartition(-flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(flat.shape[1]), flat.shape)
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(flat, best, axis=1), axis=1, kind="stable"), axis=1)
    came, word = best // len(words), best % len(words)
    return came, word, np.take_along_axis(flat, best, axis=1), np.take_along_axis(rest, came[:, :, None], axis=1) - words[word]


def probe(rows: np.ndarray, books: Codebooks, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` cells nearest to each row, nearest first, their scores, and the row's residuals there."""
    start = rows[:, None, :]
    _, one, score, rest = widen(start, np.zeros((len(rows), 1), np.float32), books.levels[0], max(keep, 8))
    came, two, score, rest = widen(rest, score, books.levels[1], keep)
    return np.take_along_axis(one, came, axis=1) * len(books.levels[1]) + two, score, rest


def encode(rows: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell, refining codes, inner product with the code's sum, and squared norm of that sum, for each row."""
    cell, score, rest = probe(rows, books, BEAM)
    codes = np.zeros((len(rows), cell.shape[1], 0), np.uint8)
    for words in books.levels[2:]:
        came, word, score, rest = widen(rest, score, words, BEAM)
        cell = np.take_along_axis(cell, came, axis=1)
        codes = np.concatenate([np.take_along_axis(codes, came[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
    summed = rows - rest[:, 0]
    return cell[:, 0], codes[:, 0], (rows * summed).sum(axis=1), (summed * summed).sum(axis=1)


def error_floor(inner: np.ndarray, square: np.ndarray, width: int, least: float) -> np.ndarray:
    """The least score, by row, at which a vector may still reach cosine ``least``."""
    inner = np.maximum(inner, 1e-3)
    spread = sqrt(max(0.0, 1 - least * least)) * np.sqrt(np.maximum(square - inner * inner, 0)) / (sqrt(max(1, width - 1)) * inner)
    return (least - MARGIN * spread - 0.02).astype(np.float32)


def _index_rows(books: Codebooks, least: float, blocks: dict[int, int], only: tuple[int, int] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of both sides by cell. With ``only`` (nth, passes), whole vectors with their smallest ids, of every so many cells."""
    names = ["cell", "block", "side", "vkey", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.ones(books.cells, np.int64)
        for cell, n in blocks.items():
            cut[cell] = n
        for batch in batches:
            for begin in range(0, batch.num_rows, 2_048):
                part = batch.slice(begin, 2_048)
                key = part.column("vkey").to_numpy()
                given = from_binary(part.column("vec"), np.float32)[0].reshape(len(key), books.width)
                rows = unit(given).astype(np.float32)
                cell, codes, inner, square = encode(rows, books)
                if only is None:
                    scale = np.abs(rows).max(axis=1, keepdims=True) / 127
                    small = np.concatenate([np.rint(rows / scale).astype(np.int8).view(np.uint8), scale.astype(np.float32).view(np.uint8)], axis=1)
                else:
                    small = np.concatenate([np.ascontiguousarray(given).view(np.uint8), part.column("least_id").to_numpy()[:, None].copy().view(np.uint8)], axis=1)
                held = np.concatenate([codes, np.stack([inner, error_floor(inner, square, books.width, least)], axis=1).astype(np.float32).view(np.uint8), small], axis=1)
                own = (mix64(key.view(np.uint64)) % cut[cell].astype(np.uint64)).astype(np.int32)
                here = slice(None) if only is None else np.flatnonzero(cell % only[1] == only[0])
                yield pa.RecordBatch.from_arrays([pa.array(cell[here].astype(np.int32)), pa.array(own[here]), pa.array(np.zeros(len(key), np.int8)[here]), pa.array(key[here]), fixed_binary(held[here])], names)
                near, _, _ = probe(rows, books, PROBES)
                who, where = np.repeat(np.arange(len(key)), near.shape[1]), near.ravel()
                if only is not None:
                    here = where % only[1] == only[0]
                    who, where = who[here], where[here]
                times = cut[where]
                who, where = np.repeat(who, times), np.repeat(where, times)
                nth = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(nth.astype(np.int32)), pa.array(np.ones(len(who), np.int8)), pa.array(key[who]), fixed_binary(small[who])], names)

    return run


def short(raw: np.ndarray, width: int) -> np.ndarray:
    """Vectors from one signed byte an element and a scale."""
    return np.ascontiguousarray(raw[:, :width]).view(np.int8) * np.ascontiguousarray(raw[:, width : width + 4]).view(np.float32)


def whole(raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as given, and their smallest ids."""
    return np.ascontiguousarray(raw[:, : 4 * width]).view(np.float32), np.ascontiguousarray(raw[:, 4 * width :]).view(np.int64)[:, 0]


def k_best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each ``who``; equal scores by the smaller id."""
    order = np.lexsort((ids, -score, who))
    sorted_ = who[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_, side="left") < k]


def _ranked(books: Codebooks, least: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, score) of each block: the ``k`` best of its vectors for each that asks, and the ``k`` best that ask for each of
    its vectors; scored exactly, equal scores by the smaller id."""
    names = ["a", "b", "score"]

    def pairs(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score)], names)

    def cut(back: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        """Of (vector, asking key, asking id, score) each vector's ``k`` best."""
        if not back:
            return back
        x, key, ids, score = (np.concatenate(c) for c in zip(*back, strict=True))
        top = k_best(x, score, ids, k)
        return [(x[top], key[top], ids[top], score[top])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refine = np.concatenate(books.levels[2:]).T.copy()
        sizes = np.cumsum([0, *map(len, books.levels[2:])])
        second = len(books.levels[1])
        now: tuple[int, int] = (-1, -1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        back: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, block, side, key = (batch.column(i).to_numpy() for i in range(4))
            edge = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)) + 1
            for begin, end in zip([0, *edge], [*edge, len(cell)], strict=True):
                here = int(cell[begin]), int(block[begin])
                raw, counts = from_binary(batch.column(4).slice(begin, end - begin), np.uint8)
                raw = raw.reshape(end - begin, counts[0])
                if here != now:
                    for x, other, _, score in cut(back):
                        yield pairs(held[0][0][x], other, score)
                    now, held, back = here, [], []
                if side[begin] == 0:
                    held.append((key[begin:end], raw))
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [(np.concatenate([k for k, _ in held]), np.concatenate([r for _, r in held]))]
                base, packed = held[0]
                codes = packed[:, :LEVELS]
                norms = np.ascontiguousarray(packed[:, LEVELS : LEVELS + 8]).view(np.float32)
                bound = (norms[:, 0] * norms[:, 1])[:, None]
                rows, ids = whole(packed[:, LEVELS + 8 :], books.width)
                light = unit(rows).astype(np.float32)
                centre = books.levels[0][here[0] // second] + books.levels[1][here[0] % second]
                for at in range(0, end - begin, 512):
                    given, asking = whole(raw[at : at + 512], books.width)
                    asked = unit(given).astype(np.float32)
                    table = np.ascontiguousarray((asked @ refine).T)
                    score = np.repeat((asked @ centre)[None, :], len(base), axis=0)
                    for level in range(LEVELS):
                        score += table[sizes[level] : sizes[level + 1]][codes[:, level]]
                    x, q = np.nonzero(score >= bound)
                    close = np.concatenate([np.einsum("ij,ij->i", light[x[i : i + 65_536]], asked[q[i : i + 65_536]]) >= least - 1e-4 for i in range(0, max(1, len(x)), 65_536)])
                    close &= base[x] != key[begin + at + q]
                    x, q = x[close], q[close]
                    exact = np.concatenate([cosine_rows(rows[x[i : i + 65_536]], given[q[i : i + 65_536]]) for i in range(0, max(1, len(x)), 65_536)])
                    close = exact >= least
                    x, q, exact = x[close], q[close], exact[close]
                    if not len(x):
                        continue
                    top = k_best(q, exact, ids[x], k)
                    yield pairs(base[x[top]], key[begin + at + q[top]], exact[top])
                    top = k_best(x, exact, asking[q], k)
                    back.append((x[top], key[begin + at + q[top]], asking[q[top]], exact[top]))
                    if sum(len(b[0]) for b in back) > HELD:
                        back = cut(back)
        for x, other, _, score in cut(back):
            yield pairs(held[0][0][x], other, score)

    return run


def _scored(books: Codebooks, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refine = np.concatenate(books.levels[2:]).T.copy()
        sizes = np.cumsum([0, *map(len, books.levels[2:])])
        second = len(books.levels[1])
        now: tuple[int, int] = (-1, -1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        found: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, block, side, key = (batch.column(i).to_numpy() for i in range(4))
            edge = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)) + 1
            for begin, end in zip([0, *edge], [*edge, len(cell)], strict=True):
                here = int(cell[begin]), int(block[begin])
                raw, counts = from_binary(batch.column(4).slice(begin, end - begin), np.uint8)
                raw = raw.reshape(end - begin, counts[0])
                if here != now:
                    now, held = here, []
                if side[begin] == 0:
                    held.append((key[begin:end], raw))
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [(np.concatenate([k for k, _ in held]), np.concatenate([r for _, r in held]))]
                base, packed = held[0]
                codes = packed[:, :LEVELS]
                norms = np.ascontiguousarray(packed[:, LEVELS : LEVELS + 8]).view(np.float32)
                bound = (norms[:, 0] * norms[:, 1])[:, None]
                rough = short(packed[:, LEVELS + 8 :], books.width)
                centre = books.levels[0][here[0] // second] + books.levels[1][here[0] % second]
                for at in range(0, end - begin, 512):
                    asked = short(raw[at : at + 512], books.width)
                    table = np.ascontiguousarray((asked @ refine).T)
                    score = np.repeat((asked @ centre)[None, :], len(base), axis=0)
                    for level in range(LEVELS):
                        score += table[sizes[level] : sizes[level + 1]][codes[:, level]]
                    x, q = np.nonzero(score >= bound)
                    closer = np.concatenate([np.einsum("ij,ij->i", rough[x[i : i + 65_536]], asked[q[i : i + 65_536]]) for i in range(0, max(1, len(x)), 65_536)])
                    x, q = x[closer >= least - 0.01], q[closer >= least - 0.01]
                    a, b = base[x], key[begin + at + q]
                    other = a != b
                    if other.any():
                        found.append(np.stack([np.minimum(a, b)[other], np.maximum(a, b)[other]]))
            if sum(f.shape[1] for f in found) > 50_000:
                both, found = np.unique(np.concatenate(found, axis=1), axis=1), []
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])
        if found:
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return run


def cosine_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of matching rows in double precision, rounded to 6 decimals."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.round((x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))), 6)


def _exact(width: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score = cosine_rows(*(from_binary(batch.column(c), np.float32)[0].reshape(n, width) for c in ("va", "vb"))) if n else np.empty(0)
            keep = score >= least
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[keep]) for c in ("a", "b")] + [pa.array(score[keep])], ["a", "b", "score"])

    return run


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, width: int = 64) -> DataFrame:
    """(id, vkey, vec): the usable vectors of ``df``; ``vkey`` is equal for equal vectors.

    Null, of another width, non-finite and zero vectors drop out, as do rows with a null id. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = decode_vectors(batch.column(1), width)
            key = np.zeros(len(rows), np.uint64)
            for column in np.ascontiguousarray(rows).view(np.uint32).astype(np.uint64).T:
                key = mix64(key + np.uint64(0x9E3779B97F4A7C15) ^ column)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(key.view(np.int64)), fixed_binary(rows)], ["id", "vkey", "vec"])

    own = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).filter("id is not null and v is not null")
    return own.mapInArrow(run, "id bigint, vkey bigint, vec binary")


def vector_groups(vectors: DataFrame, keep: int) -> DataFrame:
    """(vkey, vec, ids): one row for each distinct vector with its ``keep`` smallest ids.

    The rank limit works before the shuffle, so that a group of copies sends no more than ``keep`` ids from each task.
    """
    ranked = vectors.withColumn("rn", F.dense_rank().over(Window.partitionBy("vkey").orderBy("id"))).filter(F.col("rn") <= keep)
    return ranked.groupBy("vkey").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("ids"))


def near_pairs(groups: DataFrame, least: float, k: int | None = None, width: int = 64) -> DataFrame:
    """(a, b, score), a < b: pairs of distinct vectors of ``groups`` (a written table) with cosine >= ``least``.

    With ``k``, only what the k best of either vector may need, equal scores by the group's smallest id. Every vector is indexed and asks; recall is measured in the
    tests. No vectors at all give no pairs.
    """
    spark = groups.sparkSession
    total = groups.count()
    if not total:
        return spark.createDataFrame([], "a bigint, b bigint, score double")
    sample = groups.select("vec").orderBy(F.xxhash64("vkey")).limit(SAMPLE).toArrow().column("vec").combine_chunks()
    books = fit_codebooks(unit(from_binary(sample, np.float32)[0].reshape(-1, width)).astype(np.float32), total)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(books.cells, np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2_048):
                rows = unit(from_binary(batch.column(0).slice(begin, 2_048), np.float32)[0].reshape(-1, width)).astype(np.float32)
                count += np.bincount(probe(rows, books, 1)[0][:, 0], minlength=books.cells)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["cell", "n"])

    sizes = groups.select("vec").mapInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK // 2).collect()
    blocks = {r.cell: -(-r.n // (BLOCK // 2)) for r in sizes}
    schema = "cell int, block int, side tinyint, vkey bigint, payload binary"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(books.cells, total // 4_096))
    if k is not None:
        out = None
        for nth in range(passes := min(PASSES, books.cells)):
            rows = groups.select("vkey", "vec", F.array_min("ids").alias("least_id")).mapInArrow(_index_rows(books, least, blocks, (nth, passes)), schema)
            found = rows.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "side").mapInArrow(_ranked(books, least, k), "a bigint, b bigint, score double")
            found = materialise(found, "ranked-pairs")
            out = found if out is None else out.unionByName(found)
        return out.groupBy("a", "b").agg(F.max("score").alias("score"))
    rows = groups.select("vkey", "vec").mapInArrow(_index_rows(books, least, blocks), schema)
    pairs = rows.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "side").mapInArrow(_scored(books, least), "a bigint, b bigint").repartition("a").distinct()
    one = groups.select(F.col("vkey").alias("a"), F.col("vec").alias("va"))
    two = groups.select(F.col("vkey").alias("b"), F.col("vec").alias("vb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb").mapInArrow(_exact(width, least), "a bigint, b bigint, score double")


def best_of_side(groups: DataFrame, side: DataFrame, least: float, k: int, width: int = 64) -> DataFrame:
    """(vkey, id, score): for each vector of ``groups`` the ``k`` best of ``side`` (id, vkey, vec) with cosine >= ``least``.

    A stated set against all rows: ``side`` is taken in blocks of about ``SIDE`` rows, each broadcast, scored exactly.
    Equal scores: smaller id first.
    """
    spark = groups.sparkSession
    side = side.select("id", "vec").distinct()
    total = side.count()
    count = max(1, -(-total // SIDE))
    out = None
    for block in range(count if total else 0):
        rows = side.filter(F.pmod(F.xxhash64("id"), F.lit(count)) == block).toArrow()
        ids = rows.column("id").to_numpy()
        vectors = unit(from_binary(rows.column("vec"), np.float32)[0].reshape(-1, width))

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors) -> Iterator[pa.RecordBatch]:
            light = vectors.T.astype(np.float32)
            for batch in batches:
                for begin in range(0, batch.num_rows, 2_048):
                    part = batch.slice(begin, 2_048)
                    key = part.column("vkey").to_numpy()
                    own = unit(from_binary(part.column("vec"), np.float32)[0].reshape(-1, width))
                    q, t = np.nonzero(own.astype(np.float32) @ light >= least - 1e-4)
                    score = np.round((own[q] * vectors[t]).sum(axis=1), 6)
                    keep = score >= least
                    q, t, score = q[keep], t[keep], score[keep]
                    order = np.lexsort((ids[t], -score, q))
                    q, t, score = q[order], t[order], score[order]
                    first = np.searchsorted(q, q, side="left")
                    top = np.arange(len(q)) - first < k
                    yield pa.RecordBatch.from_arrays([pa.array(key[q[top]]), pa.array(ids[t[top]]), pa.array(score[top])], ["vkey", "id", "score"])

        found = groups.select("vkey", "vec").mapInArrow(run, "vkey bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "vkey bigint, id bigint, score double")
    if count > 1:
        out = out.withColumn("rn", F.row_number().over(Window.partitionBy("vkey").orderBy(F.desc("score"), "id"))).filter(F.col("rn") <= k).drop("rn")
    return out


def most_similar(chunks: DataFrame, tags: DataFrame | None = None, k: int = 5, least: float = 0.88, tag_k: int = 3, tag_least: float = 0.5, width: int = 64) -> DataFrame:
    """(chunk_id, neighbour_kind, neighbour_id, score): the most similar chunks and tags of every chunk.

    ``chunks`` and ``tags`` have ``id`` and ``vector``; other columns are ignored. Unusable vectors neither ask nor answer,
    repeated rows count once, equal scores put the smaller id first, and empty tables give no rows.
    """
    vectors = usable_vectors(chunks, "id", "vector", width)
    groups = materialise(vector_groups(vectors, k + 1), "vectors")
    members = usable_vectors(chunks, "id", "vector", width).select("id", "vkey")
    pairs = near_pairs(groups, least, k, width)
    ids = groups.select(F.col("vkey").alias("b"), "ids")
    both = pairs.select(F.explode(F.array(F.struct("a", "b", "score"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "score"))).alias("p")).select("p.*")
    own = groups.filter(F.size("ids") > 1).select(F.col("vkey").alias("a"), F.lit(1.0).alias("score"), F.explode("ids").alias("id"))
    reach = both.join(ids, "b").select("a", "score", F.explode("ids").alias("id")).unionByName(own)
    ranked = reach.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id"))).filter(F.col("rn") <= k + 1)
    listed = ranked.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "score"))).alias("hits"))
    hits = F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k)
    own_ids = members.distinct()
    out = own_ids.join(listed.withColumnRenamed("a", "vkey"), "vkey").select(F.col("id").alias("chunk_id"), F.lit("chunk").alias("neighbour_kind"), F.explode(hits).alias("h"))
    out = out.select("chunk_id", "neighbour_kind", F.col("h.id").alias("neighbour_id"), F.col("h.score").alias("score"))
    if tags is not None:
        tagged = best_of_side(groups, usable_vectors(tags, "id", "vector", width), tag_least, tag_k, width)
        named = own_ids.join(tagged.withColumnRenamed("id", "neighbour_id"), "vkey").select(F.col("id").alias("chunk_id"), F.lit("tag").alias("neighbour_kind"), "neighbour_id", "score")
        out = out.unionByName(named)
    return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    tags = spark.read.parquet(f"{sf_dir}/tags.parquet")
    return most_similar(chunks, tags).select("chunk_id", "neighbour_kind", "neighbour_id")
