"""Vector algebra as column expressions over array columns, and the singular value decomposition in NumPy.

All arithmetic is in double precision over stored floats.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopegrain.functions.text import col, let


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def norm_of(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def usable(v: Column | str, width: int | None = None) -> Column:
    """Whether a vector is not null, finite throughout, not all zero, and of the width asked for."""
    own = doubles(v)
    fine = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(own, lambda x: x != 0)
    return F.coalesce(fine if width is None else (F.size(own) == width) & fine, F.lit(False))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 for null, empty or unequally wide vectors and where the norms' product is under 1e-15."""
    both = F.struct(doubles(a).alias("x"), doubles(b).alias("y"))

    def value(v: Column) -> Column:
        guarded = lambda n: F.when((F.size(v["x"]) == F.size(v["y"])) & (n >= 1e-15), dot(v["x"], v["y"]) / n)
        return let(norm_of(v["x"]) * norm_of(v["y"]), guarded)

    return F.coalesce(let(both, value), F.lit(0.0))


def score(a: Column | str, b: Column | str) -> Column:
    return F.greatest(F.lit(0.0), cosine(a, b))


def normalize(v: Column | str) -> Column:
    """The vector over its norm; unchanged if the norm is at most 1e-10."""
    return let(doubles(v), lambda own: let(norm_of(own), lambda norm: F.when(norm > 1e-10, F.transform(own, lambda x: x / norm)).otherwise(own)))


def plus(a: Column, b: Column, weight: Column | float = 1.0) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.zip_with(a, b, lambda x, y: x + w * y)


def project(v: Column | str, tags: Column) -> Column:
    """Struct of ``projection``, ``residual`` and ``coefficients`` of a vector on the span of a list of vectors.

    Modified Gram-Schmidt: a vector whose rest has a norm of at most 1e-10 is skipped and its coefficient stays 0. Coefficients
    are those of the orthonormal basis, in the places of the vectors they came from. Without vectors the residual is ``v``.
    """

    def against(own: Column) -> Column:
        def grow(state: Column, tag: Column) -> Column:
            rest = F.aggregate(state["basis"], doubles(tag), lambda r, b: let(-dot(r, b), lambda w: plus(r, b, w)))

            def added(fresh: Column) -> Column:
                return F.struct(
                    F.when(fresh["keep"], F.concat(state["basis"], F.array(fresh["unit"]))).otherwise(state["basis"]).alias("basis"),
                    F.concat(state["coefficients"], F.array(F.when(fresh["keep"], dot(own, fresh["unit"])).otherwise(F.lit(0.0)))).alias("coefficients"),
                )

            scaled = let(rest, lambda r: let(norm_of(r), lambda n: F.struct((n > 1e-10).alias("keep"), F.transform(r, lambda x: F.when(n > 1e-10, x / n).otherwise(x)).alias("unit"))))
            return let(scaled, added)

        start = F.struct(F.array().cast("array<array<double>>").alias("basis"), F.array().cast("array<double>").alias("coefficients"))

        def parts(built: Column) -> Column:
            along = F.aggregate(built["basis"], F.transform(own, lambda x: x * 0), lambda p, b: let(dot(own, b), lambda w: plus(p, b, w)))
            return let(along, lambda p: F.struct(p.alias("projection"), plus(own, p, -1.0).alias("residual"), built["coefficients"].alias("coefficients")))

        return let(F.aggregate(tags, start, grow), parts)

    return let(doubles(v), against)


def energy_profile(v: Column | str, basis: Column, mean: Column) -> Column:
    """Struct of ``projections``, ``probabilities``, ``entropy`` and ``total_energy`` of a centred vector in a basis.

    Energies are squared projections; with an energy of at most 1e-15 the probabilities are uniform.
    """
    centred = F.zip_with(doubles(v), doubles(mean), lambda x, m: x - m)

    def shares(p: Column) -> Column:
        each = F.transform(p["along"], lambda x: F.when(p["energy"] > 1e-15, x * x / p["energy"]).otherwise(1.0 / F.size(p["along"])))
        entropy = lambda s: total(F.transform(s, lambda q: F.when(q > 1e-15, -q * F.log(q)).otherwise(F.lit(0.0))))
        return let(each, lambda s: F.struct(p["along"].alias("projections"), s.alias("probabilities"), entropy(s).alias("entropy"), p["energy"].alias("total_energy")))

    along = let(centred, lambda c: F.transform(basis, lambda b: dot(c, doubles(b))))
    return let(let(along, lambda a: F.struct(a.alias("along"), dot(a, a).alias("energy"))), shares)


def logic_depth(entropy: Column, k: Column) -> Column:
    """Entropy over its largest value for ``k`` components; 0.5 where that is 0."""
    most = F.log(k.cast("double"))
    return F.when(most > 0, entropy / most).otherwise(F.lit(0.5))


def beta(depth: Column, matched: Column, tags: Column, low: float = 0.1, high: float = 0.5) -> Column:
    """Weight of the boost: a logistic function of depth and tag coverage between ``low`` and ``high``; 0 without a match."""
    raw = depth * F.log(1 + matched / F.greatest(F.lit(1), tags))
    return F.when(matched > 0, low + (high - low) / (1 + F.exp(-raw))).otherwise(F.lit(0.0))


def fuse(query: Column | str, matched: Column, residual: Column, weight: Column) -> Column:
    """normalize(query + weight * sum of similarity * tag + 0.3 * weight * residual); ``matched`` lists (vector, similarity)."""
    summed = F.aggregate(matched, doubles(query), lambda a, t: let(weight * t["similarity"], lambda w: plus(a, doubles(t["vector"]), w)))
    return normalize(let(summed, lambda x: F.when(residual.isNotNull(), plus(x, residual, weight * 0.3)).otherwise(x)))


def drift(boosted: Column | str, original: Column | str) -> Column:
    return 1 - cosine(boosted, original)


def boosted_query(v: np.ndarray, tags: np.ndarray, likeness: np.ndarray, further: np.ndarray, weight: float, use_residual: bool) -> np.ndarray:
    """``project`` and ``fuse`` of one query in NumPy: its matched tags with their similarities, and tags that only span."""
    summed = v + weight * (likeness @ tags)
    if use_residual:
        basis: list[np.ndarray] = []
        for tag in np.concatenate([tags, further]):
            rest = tag.copy()
            for b in basis:
                rest -= (rest @ b) * b
            norm = np.sqrt(rest @ rest)
            if norm > 1e-10:
                basis.append(rest / norm)
        along = np.stack(basis) if basis else np.zeros((0, len(v)))
        summed = summed + 0.3 * weight * (v - (along @ v) @ along)
    norm = np.sqrt(summed @ summed)
    return summed / norm if norm > 1e-10 else summed


def boosting(use_residual: bool) -> Callable[..., Column]:
    """Column function of (vector, matched vectors, their similarities, further vectors, weight): ``boosted_query``, or the
    vector itself without a match. Queries are a stated set; one Arrow batch of them is one call."""

    @F.pandas_udf("array<double>")
    def run(vector: pd.Series, tags: pd.Series, likeness: pd.Series, further: pd.Series, weight: pd.Series) -> pd.Series:
        out = []
        for v, t, s, f, w in zip(vector, tags, likeness, further, weight, strict=True):
            v = np.asarray(v, float)
            if t is None or not len(t):
                out.append(v)
                continue
            t = np.stack([np.asarray(x, float) for x in t])
            f = np.stack([np.asarray(x, float) for x in f]) if f is not None and len(f) else np.zeros((0, len(v)))
            out.append(boosted_query(v, t, np.asarray(s, float), f, w, use_residual))
        return pd.Series(out, dtype=object)

    return run


def decompose(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and singular values of the centred rows, without the tail under 1 % of the energy."""
    centred = rows - rows.mean(axis=0)
    _, values, vectors = np.linalg.svd(centred, full_matrices=False)
    k = max(1, min(most, len(values)))
    energy = float((values**2).sum())
    while k > 1 and energy > 0 and values[k - 1] ** 2 < 0.01 * energy:
        k -= 1
    vectors, values = vectors[:k].copy(), values[:k]
    vectors[values < 1e-12] = 0
    return vectors, values


def principal_axes(most: int = 10) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For ``applyInPandas`` over (grp, vector) groups of a bounded sample: (grp, axes, strengths, k)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, values = decompose(np.stack(pdf["vector"].to_list()).astype(float), most)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "axes": [[list(map(float, v)) for v in vectors]], "strengths": [list(map(float, values))], "k": [len(values)]})

    return run


def column_means(df: DataFrame, vector: str) -> DataFrame:
    """(dimension, mean) of all vectors of a column; nulls drop out."""
    return df.select(F.posexplode(doubles(vector)).alias("dimension", "x")).groupBy("dimension").agg(F.avg("x").alias("mean"))
